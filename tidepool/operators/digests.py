"""Content digests of tables that don't depend on the order or the partitioning of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
LANES = 4


def row_text(columns: list[str]) -> Column:
    """Each value with its length before it, so that no two rows have one text; a null is a dash."""
    one = lambda x: F.coalesce(F.concat(F.length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-"))
    return F.concat_ws("|", *[one(c(n)) for n in sorted(columns)])


def lanes(text: Column) -> list[Column]:
    """Parts of a text's SHA-256 as numbers of 60 bits."""
    return [F.conv(F.substring(F.sha2(text, 256), 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(LANES)]


def summed(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, rows and digest: sums of the lanes over all rows, repeats counted. Sums of parts add up to the sum of the
    whole, so each task sends one row a key."""
    named = rows.select(*keys, *[x.alias(f"l{k}") for k, x in enumerate(lanes(text))])
    added = named.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.sum(f"l{k}").alias(f"l{k}") for k in range(LANES)])
    sealed = F.sha2(F.concat_ws(":", c("rows").cast("string"), *[c(f"l{k}").cast("string") for k in range(LANES)]), 256)
    return added.select(*keys, "rows", sealed.alias("digest"))


def part_digests(rows: DataFrame, part: str) -> DataFrame:
    """part, rows and digest of the rows' other columns."""
    return summed(rows, [part], row_text([n for n in rows.columns if n != part]))


def whole_digest(parts: DataFrame, part: str) -> DataFrame:
    """parts (count), rows and digest of a table from its parts' digests."""
    one = summed(parts.withColumn("all", F.lit(1)), ["all"], row_text([part, "digest"]))
    total = parts.withColumn("all", F.lit(1)).groupBy("all").agg(F.sum("rows").alias("total"))
    return one.join(total, "all").select(c("rows").alias("parts"), c("total").alias("rows"), "digest")


def freeze_problems(frozen: DataFrame, now: DataFrame, part: str) -> DataFrame:
    """part and problem (gone, new or changed) of the parts whose digests are not as they were frozen. Empty while the freeze holds."""
    then, later = frozen.select(part, c("digest").alias("then")), now.select(part, c("digest").alias("later"))
    met = then.join(later, part, "full")
    problem = F.when(c("later").isNull(), "gone").when(c("then").isNull(), "new").when(c("then") != c("later"), "changed")
    return met.select(part, problem.alias("problem")).where("problem is not null")


