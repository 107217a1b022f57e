"""As-of joins, content twins, duplicate detection and reconciliation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.plans.stored import discard, stored


def nearest_offset(rows: DataFrame, keys: list[str], window_seconds: int, bucket_seconds: int | None = None) -> DataFrame:
    """The nearest donor of each asking row within the window, in either direction.

    rows: keys, id, at (timestamp), offset (NULL for askers). Ties take the earlier donor,
    then the smaller offset. Donors go to the time bucket (one window wide) of theirs and the
    two beside it, so an asker meets all it may use in its own bucket; there one sort gives the last
    donor up to it and the first one after it. A hot key is spread over its buckets.
    """
    width = (bucket_seconds or window_seconds) * 1_000_000
    at = micros(F.col("at"))
    bucket = F.floor(at / width)
    # of equal times the smallest offset counts
    donors = rows.where("offset is not null").groupBy(*keys, "at").agg(F.min("offset").alias("offset"))
    donors = donors.select(*keys, F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id"), "at", F.struct("at", "offset").alias("donor"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("b"))
    askers = rows.where("offset is null").select(*keys, "id", "at", F.lit(None).cast(donors.schema["donor"].dataType).alias("donor"), bucket.alias("b"))
    upto = lambda *order: F.last("donor", True).over(Window.partitionBy(*keys, "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = upto("at", F.col("donor").isNull())
    after = upto(F.desc("at"), F.col("donor").isNull().desc())  # a frame that ends at the last row would be read anew for each row
    met = donors.unionByName(askers).withColumn("before", before).withColumn("after", after).where("donor is null")
    gap = lambda c: F.abs(micros(F.col("at")) - micros(F.col(f"{c}.at")))
    near = met.withColumn("n", F.when(F.coalesce(gap("before") <= gap("after"), F.col("before").isNotNull()), F.col("before")).otherwise(F.col("after")))
    return near.where(gap("n") <= window_seconds * 1_000_000).select(*keys, "id", F.col("n.at").alias("d_at"), F.col("n.offset").alias("d_offset"))


def micros(at: Column) -> Column:
    """Microseconds of a local time, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def neighbour_days(rows: DataFrame) -> DataFrame:
    """Undated rows with the dated neighbours of their folder by name order:
    agree, disagree, no_anchor_one_side or no_anchor. rows: folder, name, id, day."""
    upto = lambda *order: F.last("day", True).over(Window.partitionBy("folder").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    before = upto("name", "id")
    after = upto(F.desc("name"), F.desc("id"))  # a frame that ends at the last row would be read anew for each row
    found = rows.withColumn("before", before).withColumn("after", after)
    return found.withColumn("verdict", verdict(F.col("before"), F.col("after")))


def verdict(before: Column, after: Column) -> Column:
    return (
        F.when(before.isNull() & after.isNull(), "no_anchor")
        .when(before.isNull() | after.isNull(), "no_anchor_one_side")
        .when(before == after, "agree")
        .otherwise("disagree")
    )


def control(rows: DataFrame) -> DataFrame:
    """How often the neighbours of dated rows agree, and are right."""
    dated = neighbour_days(rows.where("day is not null"))
    return dated.agg(
        F.count("*").alias("dated"),
        F.count_if(F.col("verdict") == "agree").alias("offered"),
        F.count_if((F.col("verdict") == "agree") & (F.col("before") == F.col("day"))).alias("right"),
    )


def name_size_duplicates(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """unique, duplicate or collision of rows (id, name, size, sha) against a
    reference (ord, name, size, sha): the hash counts only where name and size agree. The reference
    is counted by key first, so a hot name costs one row a key."""
    named = reference.groupBy("name", "size").agg(F.count("*").alias("candidates"))
    same = reference.groupBy("name", "size", "sha").agg(F.min("ord").alias("match"))
    met = rows.join(named, ["name", "size"], "left").join(same, ["name", "size", "sha"], "left")
    kind = F.when(F.col("match").isNotNull(), "duplicate").when(F.col("candidates") > 0, "collision").otherwise("unique")
    return met.select("id", kind.alias("verdict"), "match")


def twins(files: DataFrame, tree: DataFrame) -> DataFrame:
    """Files that needn't be copied: (path, twin). A file of the tree with the same
    size and hash wins, the first by path; else one file of the dump is kept, copied
    ones first, then the shortest name, then the path. Copied files are never skipped.

    files: path, name, size, sha, copied. tree: path, size, sha. Minima instead of
    sorted groups, so a group of any size costs one row a task."""
    in_tree = tree.groupBy("size", "sha").agg(F.min("path").alias("tree_path"))
    rank = F.struct((~F.col("copied")).alias("late"), F.length("name").alias("n"), F.col("path"))
    keep = files.groupBy("size", "sha").agg(F.min(rank)["path"].alias("keep_path"))
    joined = files.join(in_tree, ["size", "sha"], "left").join(keep, ["size", "sha"])
    twin = F.coalesce("tree_path", F.when(F.col("path") != F.col("keep_path"), F.col("keep_path")))
    return joined.where(twin.isNotNull() & ~F.col("copied")).select("path", twin.alias("twin"))


def staleness(rows: DataFrame, present: DataFrame) -> DataFrame:
    """present, moved, ambiguous or gone for rows (path, name, size) against the files
    that are there (path, name, size); equal sizes narrow the candidates. Candidates are counted by
    name, and by name and size, before they meet rows."""
    there = present.select("path", F.lit(True).alias("here")).distinct()
    named = present.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    sized = present.where("size > 0").groupBy("name", "size").agg(F.count("*").alias("n_sized"), F.min("path").alias("first_sized"))
    met = rows.join(named, "name", "left").join(sized, ["name", "size"], "left").join(there, "path", "left")
    n, best = F.coalesce("n_sized", "n", F.lit(0)), F.coalesce("first_sized", "first")
    out = F.when(F.col("here"), "present").when(n == 0, "gone").when(n == 1, "moved").otherwise("ambiguous")
    return met.select("path", out.alias("verdict"), F.when(out.isin("moved", "ambiguous"), best).alias("candidate"))


STEM, DUPED = r"^(.+?)(\.[^.]+)?$", r"^(.+)_dup([2-9]|[1-9]\d+)$"


def split_name(name: str) -> tuple[str, str]:
    """(stem, extension) of a name."""
    stem, ext = re.match(STEM, name, re.S).groups() if name else ("", None)
    return stem, ext or ""


def number_runs(runs: list[tuple[str, int]]) -> list[list[tuple[int, int]]]:
    """For each (name, count) of one family in order: spans (first rank, number) of its rows. Number 1 keeps the name, and
    number n means _dupn; ranks after the first of a span go on counting. A number is skipped if the name that it would
    make is taken by then, and a name that is taken by then is numbered like any other."""
    taken, given, out = set(), {}, []
    for name, count in runs:
        stem, ext = split_name(name.lower())
        spans, rank = [], 1
        duped = re.match(DUPED, stem, re.S)
        made = duped and any(low <= int(duped[2]) < high for low, high in given.get((duped[1], ext), []))
        if (stem, ext) not in taken and not made:
            taken.add((stem, ext))
            spans.append((1, 1))
            rank = 2
        own = given.setdefault((stem, ext), [])
        skip = sorted({int(m[2]) for s, e in taken if e == ext and (m := re.match(DUPED, s, re.S)) and m[1] == stem})
        n = own[-1][1] if own else 2
        while rank <= count:
            while n in skip:
                n += 1
            end = min([x for x in skip if x > n], default=n + count)
            end = min(end, n + count - rank + 1)
            spans.append((rank, n))
            own.append((n, end))
            rank, n = rank + end - n, end
        out.append(spans)
    return out


def collision_suffix(rows: DataFrame, parts: int = 64) -> DataFrame:
    """dest, id and final: names made unique within a folder regardless of case, by name order and then id. The second and
    later of a name get the next free of _dup2, _dup3 and so on. rows: dest, name, id, all distinct.

    Rows are counted by name and by ranges of the id, so a hot name is ranked in `parts` tasks. Only families in
    which a name that already ends in _dupN meets a repeated one are numbered one after the other, by their distinct
    names and counts.
    """
    cuts = rows.selectExpr(f"percentile_approx(id, array({', '.join(f'{k / parts}D' for k in range(1, parts))}), 1000) AS c").first().c or []
    part = F.size(F.filter(F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<long>"), lambda x: x < F.col("id")))
    placed = rows.withColumn("part", part)
    counted = placed.groupBy("dest", "name", "part").agg(F.count("*").alias("n"))
    own = Window.partitionBy("dest", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = stored(counted.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))), "names")
    ext = F.lower(F.coalesce(F.regexp_extract("name", STEM, 2), F.lit("")))
    stem = F.lower(F.regexp_extract("name", STEM, 1))
    root = F.regexp_replace(stem, r"(_dup([2-9]|[1-9]\d+))+$", "")
    runs = counted.groupBy("dest", "name").agg(F.sum("n").alias("count")).withColumn("key", F.lower("name")).withColumn("family", F.struct(root.alias("root"), ext.alias("ext")))
    whole, same = Window.partitionBy("dest", "family"), Window.partitionBy("dest", "key")
    told = runs.withColumn("of_key", F.sum("count").over(same))
    told = told.withColumn("mixed", (F.max("of_key").over(whole) > 1) & F.max(stem.rlike(DUPED)).over(whole))
    told = stored(told.withColumn("earlier", F.coalesce(F.sum("count").over(same.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "families")
    plain = told.where("not mixed").select("dest", "name", F.array(F.struct(F.lit(1).cast("long").alias("rank"), (F.col("earlier") + 1).alias("number"))).alias("spans"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=pdf["name"].str.encode("utf-8")).sort_values("order")
        found = number_runs(list(zip(pdf["name"], pdf["count"])))
        return pd.DataFrame({"dest": pdf["dest"], "name": pdf["name"], "spans": [[{"rank": a, "number": b} for a, b in s] for s in found]})

    mixed = told.where("mixed").groupBy("dest", "family").applyInPandas(walk, f"dest {dict(rows.dtypes)['dest']}, name string, spans array<struct<rank:long,number:long>>")
    ruled = counted.join(plain.unionByName(mixed), ["dest", "name"]).select("dest", "name", "part", "before", "spans")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("dest", "name", "part").orderBy("id"))
    ranked = placed.join(ruled, ["dest", "name", "part"]).withColumn("rank", rank)
    span = F.element_at(F.filter("spans", lambda x: x["rank"] <= F.col("rank")), -1)
    numbered = ranked.select("dest", "id", "name", (span["number"] + F.col("rank") - span["rank"]).alias("number"))
    final = F.concat(F.regexp_extract("name", STEM, 1), F.lit("_dup"), F.col("number").cast("string"), F.regexp_extract("name", STEM, 2))
    return numbered.select("dest", "id", F.when(F.col("number") == 1, F.col("name")).otherwise(final).alias("final"))


def resolve_aliases(links: DataFrame) -> DataFrame:
    """(id, root) by following id -> target to its end, doubling the step each round. An id whose
    way never ends is on a loop or leads into one: that is an error."""
    now, reach, count = stored(links.select("id", "target"), "aliases"), 1, None
    while True:
        ahead = now.select(F.col("id").alias("target"), F.col("target").alias("next"))
        new = stored(now.join(ahead, "target", "left").select("id", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved")), "aliases")
        discard(now)
        now = new.select("id", "target")
        if not new.where("moved").limit(1).count():
            return now.select("id", F.col("target").alias("root"))
        count = links.count() if count is None else count
        if reach > count:
            raise ValueError(f"aliases run in a loop, among others from {new.where('moved').first()['id']}")
        reach *= 2


def outermost(paths: DataFrame) -> DataFrame:
    """Distinct roots that lie in no other root. A root's ancestors are its own prefixes, so
    nesting is an equi-join however many roots there are."""
    own = paths.select("root").distinct()
    parts = F.split("root", "/")
    steps = F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n")
    up = own.where(F.size(parts) > 1).select("root", steps)
    above = up.select("root", F.array_join(F.slice(F.split("root", "/"), F.lit(1), F.col("n")), "/").alias("above"))
    nested = above.join(own.select(F.col("root").alias("above")), "above", "left_semi").select("root")
    return own.join(nested, "root", "left_anti")


def blocked(rows: DataFrame, target: str, pending: DataFrame, dest: str) -> DataFrame:
    """rows whose target is, or holds, a destination that is still pending. A destination's own
    prefixes are the keys, so it is an equi-join."""
    steps = pending.select(F.col(dest).alias("d")).distinct().select("d", F.explode(F.sequence(F.lit(1), F.size(F.split("d", "/")))).alias("n"))
    keys = steps.select(F.array_join(F.slice(F.split("d", "/"), F.lit(1), F.col("n")), "/").alias(target)).distinct()
    return rows.join(keys, target, "left_semi")
