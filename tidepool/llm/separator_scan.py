"""Token counts of documents in flat token streams that have no index.

A stream is a run of ids that ends each document with a separator id. It is stored
in blocks of fixed size, so documents cross blocks at will. Each block is searched
for separators at once and gives the lengths between them; only the length before
its first separator depends on earlier blocks. The last separator before a block is
a running maximum of positions, so a prefix scan over block summaries, first within
groups of blocks and then over the groups, stitches the boundaries.

Defined results: null or empty text is a document of no tokens; ids after the last
separator of a stream are one more document that is marked as open; an empty table
gives an empty result; repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Ids of a block, and blocks of a group of the prefix scan.
BLOCK = 1 << 16
GROUP = 1 << 10


def id_type(path: str, separator: int) -> type:
    """Smallest unsigned type that holds every id of a vocabulary file (one entry a line) and the separator."""
    with open(path, "rb") as lines:
        return np.uint16 if max(separator, max((int(line.split()[1]) for line in lines if line.strip()), default=0)) < 1 << 16 else np.uint32


def write_stream(docs: DataFrame, path: str, pattern: str, separator: int, kind: type = np.uint16) -> DataFrame:
    """Token streams of docs, one a task: (stream, block, ids, names). names holds the
    doc_id of each separator of the block, to tell results apart; no scan reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        encoding = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        stream, block, waiting, names = TaskContext.get().partitionId(), 0, np.zeros(0, kind), []
        schema = pa.schema([("stream", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("names", pa.list_(pa.int64()))])

        def cut(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal block, names
            n = int((ids == separator).sum())
            own, names = names[:n], names[n:]
            block += 1
            return pa.RecordBatch.from_pylist([{"stream": stream, "block": block - 1, "ids": ids.tobytes(), "names": own}], schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = encoding.encode_ordinary_batch([t or "" for t in part.column("text").to_pylist()], num_threads=1)
                names += part.column("doc_id").to_pylist()
                waiting = np.concatenate([waiting, *(np.array([*f, separator], kind) for f in found)])
                while len(waiting) >= BLOCK:
                    yield cut(waiting[:BLOCK])
                    waiting = waiting[BLOCK:]
        if len(waiting):
            yield cut(waiting)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "stream long, block long, ids binary, names array<bigint>")


def summarise(blocks: DataFrame, separator: int, kind: type = np.uint16) -> DataFrame:
    """(stream, block, n, seps, last, lengths): ids, separators, ids up to the last
    separator, and ids between separators (the first from the block's start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, seps, last, lengths = [], [], [], []
            for raw in batch.column("ids").to_pylist():
                ids = np.frombuffer(raw, kind)
                at = np.flatnonzero(ids == separator)
                size.append(len(ids))
                seps.append(len(at))
                last.append(int(at[-1]) + 1 if len(at) else None)
                lengths.append(np.diff(at, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("stream"), batch.column("block"), pa.array(size, pa.int64()), pa.array(seps, pa.int64()), pa.array(last, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))],
                names=["stream", "block", "n", "seps", "last", "lengths"],
            )

    return blocks.select("stream", "block", "ids").mapInArrow(run, "stream long, block long, n long, seps long, last long, lengths array<bigint>")


def prefix(summary: DataFrame) -> DataFrame:
    """For each block: start (ids before it), docs (separators before it) and carry
    (ids since the separator before it)."""
    rows = summary.select("stream", "block", "n", "seps", "last", F.floor(F.col("block") / GROUP).cast("long").alias("grp"))
    inner = Window.partitionBy("stream", "grp").orderBy("block")
    outer = Window.partitionBy("stream").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("docs", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    local = local.withColumn("cut", F.max(F.col("at") + F.col("last")).over(before))
    groups = local.groupBy("stream", "grp").agg(F.sum("n").alias("gn"), F.sum("seps").alias("gs"), F.max(F.col("at") + F.col("last")).alias("gc"))
    groups = groups.withColumn("g_at", F.coalesce(F.sum("gn").over(outer), F.lit(0))).withColumn("g_docs", F.coalesce(F.sum("gs").over(outer), F.lit(0)))
    groups = groups.withColumn("g_cut", F.coalesce(F.max(F.col("g_at") + F.col("gc")).over(outer), F.lit(0))).select("stream", "grp", "g_at", "g_docs", "g_cut")
    joined = local.join(groups, ["stream", "grp"])
    start = F.col("g_at") + F.col("at")
    return joined.select(
        "stream", "block", start.alias("start"), (F.col("g_docs") + F.col("docs")).alias("docs"), (start - F.coalesce(F.col("g_at") + F.col("cut"), F.col("g_cut"))).alias("carry")
    )


def count_tokens(blocks: DataFrame, separator: int, kind: type = np.uint16) -> DataFrame:
    """(stream, block, ordinal, start, n_tokens, open) of each document; start is
    the place of its first id in the stream."""
    summary = materialize(summarise(blocks, separator, kind), "separators")
    known = summary.join(prefix(summary), ["stream", "block"])
    ended = known.select("stream", "block", "start", "docs", "carry", F.posexplode("lengths").alias("i", "length"))
    end = Window.partitionBy("stream", "block").orderBy("i")
    n = F.col("length") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)
    ended = ended.withColumn("after", F.col("start") + F.sum(F.col("length") + 1).over(end)).select(
        "stream", "block", (F.col("docs") + F.col("i")).alias("ordinal"), (F.col("after") - 1 - n).alias("start"), n.alias("n_tokens"), F.lit(False).alias("open")
    )
    last = known.groupBy("stream").agg(F.max_by(F.struct("block", "start", "n", "docs", "seps", "last", "carry"), "block").alias("b")).select("stream", "b.*")
    tail = F.when(F.col("seps") > 0, F.col("n") - F.col("last")).otherwise(F.col("n") + F.col("carry"))
    still = last.select("stream", "block", (F.col("docs") + F.col("seps")).alias("ordinal"), (F.col("start") + F.col("n") - tail).alias("start"), tail.alias("n_tokens"), F.lit(True).alias("open"))
    return ended.unionByName(still.where("n_tokens > 0"))


def document_counts(docs: DataFrame, path: str, pattern: str, separator: int) -> DataFrame:
    """Writes docs as token streams, scans them, and names the documents again."""
    kind = id_type(path, separator)
    blocks = materialize(write_stream(docs, path, pattern, separator, kind), "streams")
    counts = count_tokens(blocks, separator, kind)
    firsts = blocks.select("stream", "block", F.posexplode("names").alias("i", "doc_id"))
    base = Window.partitionBy("stream", "block")
    placed = counts.where("not open").withColumn("i", (F.col("ordinal") - F.min("ordinal").over(base)).cast("int"))
    return placed.join(firsts, ["stream", "block", "i"]).select("doc_id", "stream", "ordinal", "start", "n_tokens")
