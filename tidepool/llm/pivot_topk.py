"""Exact top-k by inner product with a pivot-distance index.

Inner products become distances by one more coordinate: within a band of similar norms, with M the
band's largest norm, each indexed vector x gets sqrt(M^2 - |x|^2) and a query q gets 0, so that
|q - x|^2 = |q|^2 + M^2 - 2 q.x. Bands of half an octave keep that coordinate small. Each vector is
keyed by its nearest pivot and its distance to it; vectors of one band, pivot and distance ring form an
annulus, and large annuli are cut into blocks of bounded size by a hash. Annuli and blocks also know the least
and the greatest distance of their vectors to every pivot. By the triangle inequality a vector whose
distances to a pivot p lie from lo to hi is no nearer to q than max(d(q,p) - hi, lo - d(q,p)), for each p.

A query first expands the annuli in the order of their bounds until they hold k vectors; the k-th score
among those bounds its answer from below. It then visits only the annuli that it hasn't seen whose bound can still
reach that score, and within an annulus only such blocks. So no product is taken twice. Scores are integer
products, so nothing depends on the floating-point bounds but which blocks are visited, and these have a margin.

Pivots come from a bounded sample and grow with the root of the number of vectors up to MOST_PIVOTS; every
vector is indexed. The table of annuli has at most RINGS rows for each pivot and band.

Defined results: vectors that are null, empty, or hold a null or a non-finite component take no part;
scaled components and scores beyond 64 bits are held at the ends of their range;
vectors of different lengths don't meet; equal vectors and repeated ids are rows of
their own, as queries (each is ranked for itself) and as candidates; a query row is never its own
candidate; ties go to smaller ids; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 1024
#: Vectors from which the pivots are chosen.
SAMPLE = 4096
LEAST_PIVOTS, MOST_PIVOTS = 16, 128
RINGS = 8
#: Vectors of a block at most, about.
BLOCK = 4096
#: Queries that travel together.
PACK = 512
#: Norm bands in an octave.
BANDS = 2
NONE = -(1 << 62)


def scaled(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array of long) of the vectors that take part."""
    v = F.transform(vec_col, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.coalesce(whole, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v")
    )


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first vectors of the sample."""
    picked = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < min(most, len(sample)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def bands_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norm band of each vector, and a norm that none of its band exceeds."""
    norm = np.sqrt((x * x).sum(axis=1))
    band = np.ceil(BANDS * np.log2(np.maximum(norm, 1e-3)) - 1e-9).astype(np.int32)
    return band, 2.0 ** (band / BANDS) * (1 + 1e-6)


def lift(x: np.ndarray, top: np.ndarray) -> np.ndarray:
    """x with the coordinate that gives each row the norm top."""
    return np.concatenate((x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))[:, None]), axis=1)


def reach(gap: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least distance of each query (its distances to the pivots) to what lies within lo and hi."""
    bound = np.zeros((len(gap), len(lo)))
    for p in range(gap.shape[1]):
        np.maximum(bound, gap[:, p : p + 1] - hi[None, :, p], out=bound)
        np.maximum(bound, lo[None, :, p] - gap[:, p : p + 1], out=bound)
    return bound


def most_score(square: np.ndarray, top: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Score that no vector at the distance bound or more exceeds, with a margin for rounding."""
    near = np.maximum(bound - 1e-6 * (1 + top[None, :]), 0)
    return (square[:, None] + (top * top)[None, :] - near * near) / 2 * (1 + 1e-9) + 1


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products, held at the ends of 64 bits."""
    largest = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if largest < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if largest < 2.0**62:
        return q @ x.T
    whole = q.astype(object) @ x.astype(object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


CELL = ["band", "pivot", "ring"]
STATS = "n long, lo binary, hi binary"


class Annuli:
    """Index of the vectors (row, id, v) of one length."""

    def __init__(self, vectors: DataFrame, dim: int):
        self.dim = dim
        sample = vectors.orderBy(F.xxhash64("row")).limit(SAMPLE).select("v").collect()
        x = np.array([r[0] for r in sample], np.int64).astype(np.float64)
        most = int(np.clip(np.sqrt(vectors.count()) / 4, LEAST_PIVOTS, MOST_PIVOTS))
        self.pivots = choose_pivots(lift(x, bands_of(x)[1]), most)
        own = distances(lift(x, bands_of(x)[1]), self.pivots).min(axis=1)
        self.edges = np.unique(np.quantile(own, np.arange(1, RINGS) / RINGS))
        pivots, edges = self.pivots, self.edges

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("v"), dim).astype(np.float64)
                band, top = bands_of(x)
                gap = distances(lift(x, top), pivots)
                pivot = gap.argmin(axis=1)
                ring = np.searchsorted(edges, gap[np.arange(len(gap)), pivot])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "v")), pa.array(band), pa.array(pivot.astype(np.int32)), pa.array(ring.astype(np.int32))], names=["row", "id", "v", *CELL])

        self.rows = materialize(vectors.mapInArrow(key, "row long, id long, v array<long>, band int, pivot int, ring int"), "annuli")
        self.blocks = self.stored()
        self.load()

    def stored(self) -> DataFrame:
        """One row a block: its rows, ids and vectors, and its distances to the pivots."""
        dim, pivots = self.dim, self.pivots

        def pack(table: pa.Table) -> pa.Table:
            v = np.array(table.column("v").combine_chunks().flatten().to_numpy(), np.int64).reshape(-1, dim)
            x = v.astype(np.float64)
            gap = distances(lift(x, bands_of(x)[1]), pivots)
            out = {c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in [*CELL, "block"]}
            raw = {"rows": table.column("row").to_numpy(), "ids": table.column("id").to_numpy(), "vectors": v, "lo": gap.min(axis=0), "hi": gap.max(axis=0)}
            return pa.table(out | {"n": pa.array([len(v)], pa.int64())} | {c: pa.array([a.tobytes()], pa.binary()) for c, a in raw.items()})

        sizes = self.rows.groupBy(*CELL).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # RINGS rows a pivot and band
        dealt = self.rows.join(F.broadcast(sizes), CELL).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        blocks = dealt.drop("blocks").groupBy(*CELL, "block").applyInArrow(pack, f"band int, pivot int, ring int, block int, {STATS}, rows binary, ids binary, vectors binary")
        return materialize(blocks.select(*CELL, "block", "n", "rows", "ids", "vectors", "lo", "hi"), "blocks")

    def load(self) -> None:
        """The annuli's bounds, from those of their blocks."""

        def join(table: pa.Table) -> pa.Table:
            at = lambda c: np.stack([np.frombuffer(b, np.float64) for b in table.column(c).to_pylist()])
            out = {c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in CELL}
            return pa.table(out | {"n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "lo": pa.array([at("lo").min(axis=0).tobytes()], pa.binary()), "hi": pa.array([at("hi").max(axis=0).tobytes()], pa.binary()), "blocks": pa.array([table.num_rows], pa.int32())})

        found = self.blocks.select(*CELL, "n", "lo", "hi").groupBy(*CELL).applyInArrow(join, f"band int, pivot int, ring int, {STATS}, blocks int").collect()
        self.cell = np.array([[r[c] for c in CELL] for r in found], np.int64).reshape(-1, 3)
        self.count, self.blocks_of = np.array([r["n"] for r in found]), [r["blocks"] for r in found]
        self.top = 2.0 ** (self.cell[:, 0] / BANDS) * (1 + 1e-6)
        bounds = lambda c: np.stack([np.frombuffer(r[c], np.float64) for r in found])
        self.lo, self.hi = bounds("lo"), bounds("hi")

    def visits(self, queries: DataFrame, k: int, first: bool) -> DataFrame:
        """Rows (band, pivot, ring, block, asks...) for the annuli each query (row, v, floor) must see: at first
        the nearest ones that hold k vectors besides the query, and then all others whose bound reaches the floor."""
        dim, pivots, cell, count, top, lo, hi, blocks = self.dim, self.pivots, self.cell, self.count, self.top, self.lo, self.hi, self.blocks_of

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, PACK):
                    part = batch.slice(at, PACK)
                    v = np.ascontiguousarray(matrix(part.column("v"), dim))
                    rows, floor = (part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "floor"))
                    x = np.concatenate((v.astype(np.float64), np.zeros((len(v), 1))), axis=1)
                    bound, square = reach(distances(x, pivots), lo, hi), (x * x).sum(axis=1)
                    most = most_score(square, top, bound)
                    order = np.argsort(-most, axis=1, kind="stable")
                    held = np.cumsum(count[order], axis=1)
                    near = np.zeros(most.shape, bool)
                    np.put_along_axis(near, order, np.concatenate((np.zeros((len(v), 1)), held[:, :-1]), axis=1) < k + 1, axis=1)
                    wanted = near if first else ~near & (most >= floor[:, None])
                    for c in np.flatnonzero(wanted.any(axis=0)):
                        who = np.flatnonzero(wanted[:, c])
                        n = int(blocks[c])
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(np.full(n, i, np.int32)) for i in cell[c]), pa.array(np.arange(n, dtype=np.int32)), *(pa.array([x.tobytes()] * n, pa.binary()) for x in (rows[who], v[who], floor[who]))],
                            names=[*CELL, "block", "q_rows", "q_vectors", "q_floor"],
                        )

        return queries.select("row", "v", "floor").mapInArrow(ask, "band int, pivot int, ring int, block int, q_rows binary, q_vectors binary, q_floor binary")

    def scores(self, visits: DataFrame, k: int) -> DataFrame:
        """The k best of each query in each block that it visits, from its floor on."""
        dim, pivots = self.dim, self.pivots

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    read = lambda c, t=np.int64: np.frombuffer(r[c], t)  # noqa: B023, E731
                    rows, ids, x = read("rows"), read("ids"), read("vectors").reshape(-1, dim)
                    asks, v, floor = read("q_rows"), read("q_vectors").reshape(-1, dim), read("q_floor")
                    q = np.concatenate((v.astype(np.float64), np.zeros((len(v), 1))), axis=1)
                    top = np.array([2.0 ** (r["band"] / BANDS) * (1 + 1e-6)])
                    bound = reach(distances(q, pivots), read("lo", np.float64)[None], read("hi", np.float64)[None])
                    use = np.flatnonzero(most_score((q * q).sum(axis=1), top, bound)[:, 0] >= floor)
                    all_scores = products(v[use], x)
                    out = [(np.zeros(0, np.int64),) * 4]
                    for i, n in enumerate(use):
                        own = np.flatnonzero((all_scores[i] >= floor[n]) & (rows != asks[n]))
                        own = own[best(all_scores[i][own], ids[own], k)]
                        out.append((np.full(len(own), asks[n]), ids[own], all_scores[i][own], rows[own]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]), pa.int64()) for c in range(4)], names=["row", "vec_id", "score", "vec_row"])

        joined = visits.join(self.blocks, [*CELL, "block"]).select("band", "rows", "ids", "vectors", "lo", "hi", "q_rows", "q_vectors", "q_floor")
        return joined.mapInArrow(score, "row long, vec_id long, score long, vec_row long")


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest products of each row that is_query holds for.

    vectors: id, v (see scaled). Vectors of each length have an index of their own; lengths are few in number.
    """
    vectors = materialize(vectors.select("id", "v", F.monotonically_increasing_id().alias("row")), "vectors")
    ranked = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "vec_row")
    out = None
    for (dim,) in vectors.select(F.size("v")).distinct().collect():
        own = vectors.where(F.size("v") == dim)
        index, queries = Annuli(own, dim), own.where(is_query)
        first = materialize(index.scores(index.visits(queries.withColumn("floor", F.lit(NONE)), k, True), k), "nearest")
        kth = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("row", F.col("score").alias("floor"))
        again = queries.join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))
        found = first.unionByName(index.scores(index.visits(again, k, False), k))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "row long, vec_id long, score long, vec_row long")
    top = out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return top.join(vectors.select("row", F.col("id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")
