"""Content anchors: the frame that exact repeat removal over bytes and words shares.

A unit is a byte or a word. Two equal runs of `span` units hold the same anchor
at the same place: the smallest hash among their grams of `gram` units. So equal
runs meet wherever their anchor is sent, and what a match needs to know lies in
the anchor's context, the units within reach of a run that holds the anchor.

1. Each chunk of documents sends its distinct anchors to shards (hash only). A
   shard answers which anchors occur in more than one document.
2. The chunk sends the distinct contexts of those anchors with the smallest
   doc_id that it saw them in. The shard, which now holds all contexts of its
   anchors, finds by the method of the operator which runs also start in a
   document with a smaller doc_id.
3. The chunk turns the answers into removed runs.

Chunks and shards are as many as the measured bytes of text need, whatever the session's
number of shuffle partitions. A document is in one chunk, so a chunk is at most that and the longest
document. A passage that any number of documents share sends one row of each chunk, so no hot passage,
source or group of copies gathers in one place. Every stage follows from the
input alone and can run again after a lost executor.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, utf8

U = np.uint64
STEP = 1 << 16
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: Text bytes of a chunk. Beyond some terabytes chunks grow with the root of the corpus, up to the most,
#: which keeps the rows between chunks and shards in proportion to the text.
CHUNK_BYTES, MOST_BYTES, ROOT_BYTES = 12 << 20, 64 << 20, 6
LAST_ID = np.iinfo(np.int64).max


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(32))) * U(0x94D049BB133111EB)
    return (h ^ (h >> U(29))) | U(1)


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of gram values: halves are joined by polynomial steps."""

    def run(k: int) -> np.ndarray:
        if k == 1:
            return values
        half = run(k // 2)
        out = half[: len(half) - k // 2] * U(pow(FACTOR, k // 2, 1 << 64)) + half[k // 2 :]
        if k % 2:
            out = out[:-1] * U(FACTOR) + values[k - 1 :]
        return out

    return mixed(run(gram)) if len(values) >= gram else np.zeros(0, U)


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


@dataclass
class Chunk:
    """Documents as one run of units. doc[i] bounds document i's units."""

    ids: np.ndarray
    values: np.ndarray
    bounds: np.ndarray
    gram: int
    span: int

    def whole(self, lo: int, hi: int) -> np.ndarray:
        """Whether the run that starts at each unit from lo to hi lies in one document."""
        a, b = np.searchsorted(self.bounds[1:], (lo, hi + self.span), side="right")
        ends = self.bounds[1 + a : 1 + b]
        change = np.zeros(hi - lo + 1, np.int32)
        np.add.at(change, np.clip(np.maximum(self.bounds[a:b], ends - self.span + 1) - lo, 0, hi - lo), 1)
        np.add.at(change, np.clip(ends - lo, 0, hi - lo), -1)
        return np.cumsum(change[:-1]) == 0

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, position, document) of each anchor, by position."""
        n, grams = len(self.values), self.span - self.gram + 1
        if n < self.span:
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes, places = [], []
        for lo in range(0, n - self.span + 1, STEP):
            hi = min(lo + STEP, n - self.span + 1)
            h = gram_hashes(self.values[lo : hi + self.span - 1].astype(U) + U(1), self.gram)
            least = np.where(self.whole(lo, hi), sliding(h, grams, np.minimum), U(0))
            edge = np.zeros(grams - 1, U)
            at = np.flatnonzero(sliding(np.concatenate((edge, least, edge)), grams, np.maximum) == h)
            hashes.append(h[at])
            places.append(at + lo)
        place, first = np.unique(np.concatenate(places), return_index=True)
        return np.concatenate(hashes)[first], place, np.searchsorted(self.bounds, place, side="right") - 1

    def reach(self, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) unit of the contexts of anchors."""
        first = np.maximum(self.bounds[doc], place - (self.span - self.gram))
        return first, np.minimum(self.bounds[doc + 1], place + self.span)


@dataclass
class Frame:
    """What differs between the operators.

    load: chunk table -> (Chunk, source). context: (source, first, last unit) -> bytes.
    solve: (contexts, smallest doc ids, anchor hashes) -> for each context an unsigned
    integer whose bit s is set if the run of span units that starts at its unit s also
    starts in a document with a smaller id. report: (table, chunk, source, removed) -> table.
    """

    load: Callable
    context: Callable
    solve: Callable
    report: Callable
    schema: str


def distinct_anchors(h: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, whether each is in two documents at least, and the
    number of each anchor's hash."""
    if not len(h):
        return h, np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    ranked, owner = h[order], ids[doc[order]]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(new)
    several = np.minimum.reduceat(owner, starts) < np.maximum.reduceat(owner, starts)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[starts], several, number


def by_shard(h: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, indices in order) of hashes."""
    shard = (h % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], shard[order][1:] != shard[order][:-1]))) if len(h) else []
    return [(int(shard[part[0]]), part) for part in np.split(order, starts[1:]) if len(part)]


def sorted_chunk(table: pa.Table) -> pa.Table:
    """By doc_id, and by text among rows of one doc_id: each stage sees one order."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def doc_ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(int(LAST_ID)).to_numpy(zero_copy_only=False)


def rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def short(h: np.ndarray) -> bytes:
    """The upper 40 bits of each hash. Anchors that these confuse within a shard
    count as shared, which costs a context and changes no result."""
    return (h >> U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def long(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return np.concatenate((part, np.zeros((len(part), 3), np.uint8)), axis=1).view("<u8")[:, 0].astype(U)


def packed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def send_anchors(table: pa.Table, frame: Frame, shards: int) -> pa.Table:
    table = sorted_chunk(table)
    chunk, _ = frame.load(table)
    h, _, doc = chunk.anchors()
    known, several, _ = distinct_anchors(h, doc, chunk.ids)
    ck = table.column("ck")[0].as_py()
    parts = by_shard(known, shards)
    return rows({
        "shard": ([s for s, _ in parts], pa.int32()),
        "ck": ([ck] * len(parts), pa.int32()),
        "hashes": ([short(known[p]) for _, p in parts], pa.binary()),
        "several": ([np.packbits(several[p]).tobytes() for _, p in parts], pa.binary()),
    })


def answer_anchors(table: pa.Table) -> pa.Table:
    hashes = [long(x) for x in table.column("hashes").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(table.column("several").to_pylist(), hashes)]
    all_hashes = np.concatenate(hashes)
    ranked, number, count = np.unique(all_hashes, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[number[np.concatenate(several)]] = True
    flags = np.split(shared[number], np.cumsum([len(h) for h in hashes])[:-1])
    return rows({
        "ck": (table.column("ck").to_pylist(), pa.int32()),
        "shard": (table.column("shard").to_pylist(), pa.int32()),
        "shared": ([np.packbits(f).tobytes() for f in flags], pa.binary()),
    })


class Contexts:
    """The contexts of a chunk's shared anchors, found again in each stage."""

    def __init__(self, table: pa.Table, answers: pa.Table, frame: Frame, shards: int):
        self.chunk, self.source = frame.load(table)
        h, place, doc = self.chunk.anchors()
        known, _, number = distinct_anchors(h, doc, self.chunk.ids)
        shared = np.zeros(len(known), bool)
        answer = dict(zip(answers.column("shard").to_pylist(), answers.column("shared").to_pylist()))
        for shard, part in by_shard(known, shards):
            shared[part] = np.unpackbits(np.frombuffer(answer[shard], np.uint8), count=len(part)).astype(bool)
        use = shared[number]
        self.place, self.doc, h = place[use], doc[use], h[use]
        self.first, self.last = self.chunk.reach(self.place, self.doc)
        keys: dict[bytes, int] = {}
        left = (self.place - self.first).tolist()
        made = frame.context(self.source, self.first, self.last)
        self.number = np.fromiter((keys.setdefault(bytes((n,)) + c, len(keys)) for n, c in zip(left, made)), np.int64, len(left))
        self.keys = list(keys)
        _, at = np.unique(self.number, return_index=True)
        self.hashes, self.owner = h[at], self.chunk.ids[self.doc[at]]
        self.parts = by_shard(self.hashes, shards)


def send_contexts(table: pa.Table, answers: pa.Table, frame: Frame, shards: int) -> pa.Table:
    table = sorted_chunk(table)
    found = Contexts(table, answers, frame, shards)
    ck = table.column("ck")[0].as_py()
    return rows({
        "shard": ([s for s, _ in found.parts], pa.int32()),
        "ck": ([ck] * len(found.parts), pa.int32()),
        "hashes": ([(found.hashes[p] >> U(32)).astype(np.uint32).tobytes() for _, p in found.parts], pa.binary()),
        "owners": ([packed(found.owner[p].tobytes()) for _, p in found.parts], pa.binary()),
        "sizes": ([packed(np.array([len(found.keys[i]) for i in p], np.int32).tobytes()) for _, p in found.parts], pa.binary()),
        "keys": ([packed(b"".join([found.keys[i] for i in p])) for _, p in found.parts], pa.binary()),
    })


def answer_contexts(table: pa.Table, frame: Frame, limit: int) -> pa.Table:
    """Contexts that several chunks sent count once, with the smallest doc_id."""
    unique: dict[bytes, int] = {}
    numbers, owners, hashes = [], [], []
    for keys, sizes, owner, h in zip(*(table.column(c).to_pylist() for c in ("keys", "sizes", "owners", "hashes"))):
        keys = unpacked(keys)
        ends = np.cumsum(np.frombuffer(unpacked(sizes), np.int32).astype(np.int64)).tolist()
        numbers.append(np.array([unique.setdefault(keys[a:b], len(unique)) for a, b in zip([0, *ends[:-1]], ends)], np.int64))
        owners.append(np.frombuffer(unpacked(owner), np.int64))
        hashes.append(np.frombuffer(h, np.uint32).astype(U))
    number, owner = np.concatenate(numbers), np.concatenate(owners)
    least = np.full(len(unique), LAST_ID)
    np.minimum.at(least, number, owner)
    h = np.empty(len(unique), U)
    h[number] = np.concatenate(hashes)
    keys, bits = list(unique), np.zeros(len(unique), U)
    groups = -(-len(keys) // limit)
    group = mixed(h) % U(groups)
    order = np.argsort(group, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        bits[part] = frame.solve([keys[i] for i in part.tolist()], least[part])
    own = np.where(owner > least[number], ~U(0), bits[number])
    at = np.cumsum([len(n) for n in numbers])[:-1]
    return rows({
        "ck": (table.column("ck").to_pylist(), pa.int32()),
        "shard": (table.column("shard").to_pylist(), pa.int32()),
        "bits": ([x.tobytes() for x in np.split(own, at)], pa.binary()),
        "shared": ([None] * len(numbers), pa.binary()),
    })


def apply_answers(table: pa.Table, answers: pa.Table, frame: Frame, shards: int) -> pa.Table:
    table = sorted_chunk(table)
    first_round = answers.filter(pc.is_valid(answers.column("shared")))
    second = answers.filter(pc.is_null(answers.column("shared")))
    found = Contexts(table, first_round, frame, shards)
    chunk = found.chunk
    bits = np.zeros(len(found.keys), U)
    answer = dict(zip(second.column("shard").to_pylist(), second.column("bits").to_pylist()))
    for shard, part in found.parts:
        bits[part] = np.frombuffer(answer[shard], U)
    own = np.where(chunk.ids[found.doc] > found.owner[found.number], ~U(0), bits[found.number]) if len(found.doc) else np.zeros(0, U)
    change = np.zeros(len(chunk.values) + 1, np.int16)  # no unit lies in more than span * span runs
    room = found.last - found.first - chunk.span
    for s in range(chunk.span - chunk.gram + 1):
        starts = found.first[(own >> U(s) & U(1)).astype(bool) & (room >= s)] + s
        np.add.at(change, starts, 1)
        np.add.at(change, starts + chunk.span, -1)
    return frame.report(table, chunk, found.source, np.cumsum(change[:-1], dtype=np.int16) > 0)


def remove_repeats(docs: DataFrame, frame: Frame, limit: int) -> DataFrame:
    """The operator's report of each document. limit: contexts solved at once."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(max(CHUNK_BYTES, ROOT_BYTES * math.isqrt(total)), MOST_BYTES)
    shards = max(2 * parallelism(docs.sparkSession), -(-total // size))
    # rows without an id are dealt by their text as well
    key = F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 200))
    chunks = docs.withColumn("ck", F.pmod(key, F.lit(shards)).cast("int")).repartition(shards, "ck").groupBy("ck")
    anchors = chunks.applyInArrow(lambda t: send_anchors(t, frame, shards), "shard int, ck int, hashes binary, several binary")
    shared = anchors.repartition(shards, "shard").groupBy("shard").applyInArrow(answer_anchors, "ck int, shard int, shared binary")
    contexts = chunks.cogroup(shared.groupBy("ck")).applyInArrow(
        lambda t, a: send_contexts(t, a, frame, shards) if t.num_rows else EMPTY_CONTEXTS,
        "shard int, ck int, hashes binary, owners binary, sizes binary, keys binary",
    )
    solved = contexts.repartition(shards, "shard").groupBy("shard").applyInArrow(lambda t: answer_contexts(t, frame, limit), "ck int, shard int, bits binary, shared binary")
    answers = solved.unionByName(shared.withColumn("bits", F.lit(None).cast("binary")))
    return chunks.cogroup(answers.groupBy("ck")).applyInArrow(lambda t, a: apply_answers(t, a, frame, shards), frame.schema)


EMPTY_CONTEXTS = rows({"shard": ([], pa.int32()), "ck": ([], pa.int32()), "hashes": ([], pa.binary()), "owners": ([], pa.binary()), "sizes": ([], pa.binary()), "keys": ([], pa.binary())})


def bytes_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return utf8(table.column("text"))
