"""Product codes of vectors, whose codebooks are learned with LAESA pivots.

Vectors become integers floor(256 * x) and are cut into PARTS equal parts. Each part position has a
codebook that starts as that part of the ENTRIES smallest ids. The distances from every part to PIVOTS
fixed pivots (parts of the first codebook, far from each other) are computed once and stored beside
the parts. In each round the distances from the pivots to the codebook's entries are few; by
the triangle inequality |d(part, pivot) - d(pivot, entry)| is at most d(part, entry), so entries are taken in
the order of that bound and exact integer distances are evaluated only while the bound can still beat
the best one. Bounds are floats and are lowered by SLACK of their size before they prune, so no tie
is lost.

A round is one scan: tasks send the counts and sums of their rows by (part, entry), PARTS * ENTRIES
rows at most. Codebooks are that small too, and travel with the plan.

Defined results: rows whose vector is null, empty or holds null or non-finite components are left out, as
are vectors of another length than the smallest id's, or of a length that PARTS doesn't divide
(no codebook has parts of their size). Integers are clipped to CLIP, so that sums of squares stay
exact. Repeated ids are rows of their own (ordered by vector); a null id comes last. With fewer
than ENTRIES rows the codebook has that many entries. A null label is a label. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 3
CLIP = 1 << 25
SLACK = 1e-5
#: Rows that are assigned at once, and labels that are broadcast at most.
BLOCK = 4096
LABELS = 100_000


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v (integers) of rows whose vectors are complete."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    whole &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floor = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(CLIP))), F.lit(float(-CLIP)))).cast("int")
    return rows.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", floor).alias("v"))


def far_apart(entries: np.ndarray, many: int) -> np.ndarray:
    """many rows of entries, each the farthest from those taken before."""
    taken = [0]
    gap = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(taken) < min(many, len(entries)):
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((entries - entries[taken[-1]]) ** 2).sum(axis=1))
    return entries[taken]


def to_pivots(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) distances."""
    return np.sqrt(((parts[:, None, :] - pivots[None]) ** 2).sum(axis=2, dtype=np.int64).astype(np.float64))


def nearest(parts: np.ndarray, away: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry (the smallest of equally near ones), its squared distance, and
    the number of distances evaluated. away: distances from the rows to the pivots."""
    ahead = to_pivots(entries, pivots)
    bound = np.zeros((len(parts), len(entries)))
    for p in range(ahead.shape[1]):
        near, far = away[:, p, None], ahead[None, :, p]
        np.maximum(bound, np.abs(near - far) - SLACK * (near + far), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    best, index = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), len(entries))
    live, evaluated = np.arange(len(parts)), 0
    for k in range(len(entries)):
        live = live[bound[live, k] <= np.sqrt(best[live].astype(np.float64)) * (1 + SLACK)]
        if not len(live):
            break
        entry = order[live, k]
        gap = ((parts[live] - entries[entry]) ** 2).sum(axis=1, dtype=np.int64)
        evaluated += len(live)
        better = (gap < best[live]) | ((gap == best[live]) & (entry < index[live]))
        best[live[better]], index[live[better]] = gap[better], entry[better]
    return index, best, evaluated


def blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, parts, pivot distances) of each BLOCK of rows; parts as (rows, PARTS, width)."""
    for lo in range(0, batch.num_rows, BLOCK):
        part = batch.slice(lo, BLOCK)
        flat = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        away = part.column("away").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield lo, flat.reshape(part.num_rows, -1, width), away.reshape(part.num_rows, flat.size // width // part.num_rows, -1)


def with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with away: each part's distances to the pivots of its position, computed once."""
    parts, _, width = pivots.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, parts, width)
                away = np.stack([to_pivots(v[:, p], pivots[p]) for p in range(parts)], axis=1).astype(np.float32)
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * (away.size // part.num_rows)
                cols = [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(away.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names, "away"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, away array<float>")


def moved(rows: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """books after one round: each entry the floor of the mean of the parts nearest to it."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, v, away in blocks(batch, width):
                for p in range(parts):
                    at, _, _ = nearest(v[:, p], away[:, p], books[p], pivots[p])
                    count[p] += np.bincount(at, minlength=entries)
                    np.add.at(total[p], at, v[:, p])
        part, entry = np.nonzero(count)
        sums = total[part, entry]
        offsets = np.arange(len(part) + 1, dtype=np.int32) * width
        cols = [pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.reshape(-1)))]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", "total"])

    sent = rows.select("v", "away").mapInArrow(run, "part long, entry long, n long, total array<long>")
    wide = [F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)]
    after = books.copy()
    for r in sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # one row an entry at most
        after[r.part, r.entry] = [r[f"t{k}"] // r.n for k in range(width)]
    return after


def coded(rows: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, label, code (one byte a part) and error."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, v, away in blocks(batch, width):
                found = [nearest(v[:, p], away[:, p], books[p], pivots[p]) for p in range(parts)]
                code = np.stack([at for at, _, _ in found], axis=1).astype(np.uint8)
                error = np.sum([gap for _, gap, _ in found], axis=0)
                ids, labels = (batch.column(n).slice(lo, len(v)) for n in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {dict(rows.dtypes)['label']}, code binary, error long")


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(parts, entries, width): the parts of the smallest ids; None if no row can be cut."""
    least = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()]
    if not least or len(least[0]) % parts:
        return None
    fitting = rows.where(F.size("v") == len(least[0]))
    heads = [r.v for r in fitting.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]  # entries rows at most
    return np.array(heads, np.int64).reshape(len(heads), parts, -1).transpose(1, 0, 2)


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """(stored rows with pivot distances, codebooks, pivots) after the rounds; rows as of `integers`."""
    books = first_books(rows, parts, entries)
    if books is None:
        return None
    pivots = np.stack([far_apart(b, PIVOTS) for b in books])
    kept = materialize(with_pivots(rows.where(F.size("v") == books.shape[0] * books.shape[2]), pivots), "parts")
    for _ in range(rounds):
        books = moved(kept, books, pivots)
    return kept, books, pivots


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of the embeddings."""
    learned = learn(integers(rows))
    if learned is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    kept, books, pivots = learned
    found = materialize(coded(kept, books, pivots), "codes")
    by_label = materialize(found.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    if by_label.limit(LABELS + 1).count() <= LABELS:
        by_label = F.broadcast(by_label)
    by_label = by_label.withColumnRenamed("label", "of")
    joined = found.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The rounds unrolled: every part against every entry."""

    def assign(name: str, books: str) -> str:
        return f"""{name} AS (
            SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
                SELECT s.r, s.p, b.e, CAST(list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
                FROM parts s JOIN {books} b USING (p)) GROUP BY r, p)"""

    def move(name: str, books: str, near: str) -> str:
        return f"""{name} AS (
            SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
                SELECT p, e, list(x ORDER BY k) AS v FROM (
                    SELECT p, e, k, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x
                    FROM (SELECT s.p, a.e, unnest(s.v) AS x, generate_subscripts(s.v, 1) AS k FROM parts s JOIN {near} a USING (r, p))
                    GROUP BY p, e, k) GROUP BY p, e) m USING (p, e))"""

    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
            SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM v, range({PARTS}) t(p)),
        b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {ENTRIES}),
        {assign("a0", "b0")},
        {move("b1", "b0", "a0")},
        {assign("a1", "b1")},
        {move("b2", "b1", "a1")},
        {assign("a2", "b2")},
        codes AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
        book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
        SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, codebooks_sha256
        FROM codes JOIN v USING (r), book
    """
