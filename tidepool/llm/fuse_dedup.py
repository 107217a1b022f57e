"""Exact duplicates through static binary-fuse filters of immutable snapshots.

Documents are taken in batches by ascending doc_id. A batch's digests (64 bits of the normalised text) are
grouped on their own first, counted before they are shuffled. The distinct ones are screened by the filters of
all earlier snapshots: about 9 bits a digest, false positives in one of 256, and no false negatives. Only
positives join the snapshots' exact buckets. What isn't found becomes the next snapshot, with one
filter a bucket, built where the bucket lies; snapshots are written once and never change.

The first document of a digest is its candidate. The bytes of every document of a digest that occurs twice or more are compared
with the candidate's; those that differ (colliding digests) are grouped by their whole texts. So
the result doesn't rest on the digest. Large groups are dealt over salts, and the candidate's text is
copied to each.

Buckets grow with the number of documents and hold about BUCKET digests. Digests with more than `hot_rows` documents are at most
HOT, so they can be broadcast.

Defined results: null text counts as empty; a null doc_id comes after all others (keep_id is null if a group has no
other); of repeated rows of one document exactly one stays; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, parallelism

BATCHES = 3
BUCKET = 1 << 18
#: Digests with more than one in HOT of all documents can't be more than HOT.
HOT = 1 << 16
#: A salt's documents, and repeated digests that are broadcast at most to leave out texts that have no copy.
SALT_ROWS = 1 << 12
KEYS = 1 << 20
LAST = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64 bits (fixed constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fuse:
    """Binary-fuse filter with 8-bit fingerprints: a key's three cells lie in three adjacent segments and xor to its fingerprint."""

    def __init__(self, seed: int, segment: int, cells: np.ndarray):
        self.seed, self.segment, self.cells = seed, segment, cells

    @staticmethod
    def places(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """(3, keys) cells and the fingerprints."""
        h = mix(keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        low = mix(h ^ np.uint64(0x2545F4914F6CDD1D))
        first = ((h >> np.uint64(32)) * np.uint64(starts) >> np.uint64(32)).astype(np.int64) * segment
        mask = np.uint64(segment - 1)
        at = [first + k * segment + (low >> np.uint64(20 * k) & mask).astype(np.int64) for k in range(3)]
        return np.stack(at), (h & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> Fuse:
        """keys: distinct. Cells that only one key uses are peeled in rounds; the keys' cells are set in reverse order."""
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
        room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        starts = max(1, int(np.ceil(room / segment)) - 2)
        for seed in range(1, 1000):
            at, print_ = cls.places(keys, seed, segment, starts)
            size = (starts + 2) * segment
            many = np.bincount(at.reshape(-1), minlength=size)
            owner = np.zeros(size, np.int64)
            for row in at:
                np.bitwise_xor.at(owner, row, np.arange(len(keys)))
            order, left = [], len(keys)
            single = np.flatnonzero(many == 1)
            while len(single):
                key, where = np.unique(owner[single], return_index=True)
                order.append((key, single[where]))
                left -= len(key)
                gone = at[:, key]
                np.subtract.at(many, gone.reshape(-1), 1)
                np.bitwise_xor.at(owner, gone.reshape(-1), np.tile(key, 3))
                touched = np.unique(gone)
                single = touched[many[touched] == 1]
            if left:
                continue
            cells = np.zeros(size, np.uint8)
            for key, cell in reversed(order):
                cells[cell] = print_[key] ^ np.bitwise_xor.reduce(cells[at[:, key]], axis=0)
            return cls(seed, segment, cells)
        raise ValueError("no seed gives a filter: keys must be distinct")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the filter and one of 256 others."""
        at, print_ = self.places(keys, self.seed, self.segment, len(self.cells) // self.segment - 2)
        return np.bitwise_xor.reduce(self.cells[at], axis=0) == print_


def normalised(column: str = "text") -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def digests(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, key, sha (32 bytes) and copies (rows alike in all three)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("text"))
    rows = texts.select("doc_id", digest(F.col("text"), bits).alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"))
    return materialize(rows.groupBy("doc_id", "key", "sha").agg(F.count("*").alias("copies")), "digests")


def freeze(entries: DataFrame, snapshot: int) -> tuple[DataFrame, DataFrame]:
    """A snapshot of entries (bucket, key, keep, copies): its exact buckets and its filters, both stored."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(np.uint64)
        made = Fuse.build(keys)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "snapshot": [snapshot], "seed": [made.seed], "segment": [made.segment], "cells": [made.cells.tobytes()]})

    exact = materialize(entries.withColumn("snapshot", F.lit(snapshot).cast("long")), "snapshot")
    filters = exact.select("bucket", "key").groupBy("bucket").applyInArrow(run, "bucket long, snapshot long, seed long, segment long, cells binary")
    return exact, materialize(filters, "filters")


def screen(fresh: DataFrame, filters: DataFrame) -> DataFrame:
    """(bucket, snapshot, key) that a snapshot's filter may hold."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, out = left.column("key").to_numpy(), []
        for f in right.to_pylist():
            found = keys[Fuse(f["seed"], f["segment"], np.frombuffer(f["cells"], np.uint8)).holds(keys.view(np.uint64))]
            out.append(pa.table({"bucket": np.full(len(found), f["bucket"]), "snapshot": np.full(len(found), f["snapshot"]), "key": found}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], pa.int64()) for n in ("bucket", "snapshot", "key")})

    return fresh.select("bucket", "key").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(run, "bucket long, snapshot long, key long")


def candidates(rows: DataFrame, batches: int) -> DataFrame:
    """key, keep (smallest doc_id; LAST for a null one) and copies of every digest, through snapshots of the batches."""
    rows = rows.select("key", F.coalesce("doc_id", F.lit(LAST)).alias("id"), "copies")
    buckets = max(1, -(-rows.count() // BUCKET))
    cuts = rows.selectExpr(f"percentile_approx(id, array({', '.join(f'{k / batches}D' for k in range(1, batches))}), 1000) AS c").first().c if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    exact, filters, again = [], [], []
    for low, high in zip(bounds, bounds[1:]):
        part = rows.where((F.lit(True) if low is None else F.col("id") > low) & (F.lit(True) if high is None else F.col("id") <= high))
        fresh = part.groupBy("key").agg(F.min("id").alias("keep"), F.sum("copies").alias("copies"))
        fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        if exact:
            fresh = materialize(fresh, "batch")
            hits = screen(fresh, union(filters))
            found = materialize(hits.join(union(exact).select("bucket", "snapshot", "key", "keep"), ["bucket", "snapshot", "key"]).select("key", "keep"), "found")
            again.append(fresh.drop("keep").join(found, "key").select("key", "keep", "copies"))
            fresh = fresh.join(found, "key", "left_anti").select(fresh.columns)
        for kept, made in zip((exact, filters), freeze(fresh, len(exact))):
            kept.append(made)
    seen = union([e.select("key", "keep", "copies") for e in exact] + again)
    return materialize(seen.groupBy("key").agg(F.min("keep").alias("keep"), F.sum("copies").alias("copies")), "candidates")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def attach(rows: DataFrame, found: DataFrame, hot_rows: int) -> DataFrame:
    """rows joined to found (key, copies and others): digests of more than hot_rows documents are few and broadcast."""
    hot = F.broadcast(found.where(F.col("copies") > hot_rows))
    heated = rows.join(hot, "key")
    cold = rows.join(hot.select("key"), "key", "left_anti").join(found.where(F.col("copies") <= hot_rows), "key")
    return heated.unionByName(cold)


def colliding(docs: DataFrame, found: DataFrame, bits: int, hot_rows: int) -> DataFrame:
    """doc_id, key and text of the documents whose bytes differ from their candidate's."""
    repeated = found.where("copies > 1").withColumn("salts", F.ceil(F.col("copies") / SALT_ROWS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("text"))
    texts = texts.withColumn("key", digest(F.col("text"), bits)).withColumn("row", F.monotonically_increasing_id())
    few = repeated.limit(KEYS + 1).count() <= KEYS
    tagged = texts.join(F.broadcast(repeated), "key") if few else attach(texts, repeated, hot_rows)
    first = tagged.where(F.coalesce("doc_id", F.lit(LAST)) == F.col("keep")).dropDuplicates(["key"])
    copied = first.select("key", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    dealt = tagged.withColumn("salt", F.pmod("row", F.col("salts"))).select("doc_id", "key", "salt", "text")
    return materialize(dealt.join(copied, ["key", "salt"]).where("text != kept_text").select("doc_id", "key", "text"), "colliding")


def copies(docs: DataFrame, batches: int = BATCHES, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (doc_id, text)."""
    rows = digests(docs, bits)
    found = candidates(rows, batches)
    hot_rows = max(1 << 16, rows.agg(F.sum("copies")).first()[0] // HOT if found.limit(1).count() else 0)
    apart = colliding(docs, found, bits, hot_rows)
    if apart.limit(1).count():
        groups = apart.groupBy("text").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("keep"), F.count("*").alias("group_size"))
        own = apart.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
        parted = own.join(groups, "text").withColumn("sha", F.unhex(F.sha2("text", 256))).drop("text")
        gone = apart.select(F.col("doc_id").alias("d"), F.unhex(F.sha2("text", 256)).alias("s")).distinct()
        rows = materialize(rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s")), "left_anti"), "alike")
        sizes = rows.groupBy("key").agg(F.sum("copies").alias("copies"))
        found = materialize(found.drop("copies").join(sizes, "key"), "candidates")
    else:
        parted = None
    joined = attach(rows.withColumnRenamed("copies", "own"), found, hot_rows)
    out = joined.select("doc_id", "sha", "keep", F.col("own").alias("copies"), F.col("copies").alias("group_size"))
    if parted is not None:
        out = out.unionByName(parted.select(out.columns))
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = (F.coalesce("doc_id", F.lit(LAST)) == F.col("keep")) & (F.col("copy") == 1)
    return each.select("doc_id", F.when(F.col("keep") != LAST, F.col("keep")).alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE_SQL = r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
           row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS kept, sha256(text) AS text_sha256
    FROM t
"""
