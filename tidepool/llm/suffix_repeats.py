"""Suffix-array removal of repeated bytes across documents.

A byte goes if it lies in a run of 50 bytes that also starts in a document with a
smaller doc_id. Anchors (see anchors.py) bring together the contexts in which
such runs can match. A shard lays its contexts out one after another by doc_id and sorts all
their suffixes of 50 bytes or more by prefix doubling: ranks of 7, 14, 28 and 56 bytes, each pair of ranks
making the next, where the end of a context sorts before every byte. Order and prefixes beyond 56 bytes don't
bear on factors of 50. The same ranks give the longest common
prefix (LCP) of neighbours in suffix order, longest steps first.

The longest previous factor of a suffix is the longer of two prefixes: the one it shares with the previous
smaller and the one with the next smaller position in suffix order, where smaller means of a smaller
doc_id. A factor is at least as short as the LCP of every neighbour on its way, so only runs of neighbours
whose LCPs reach 50 are walked. A suffix with a factor of 50 or more is a later copy; the
first copy has none and stays.

Defined results: null text is empty; a null doc_id counts as the largest id;
rows with the same doc_id never match each other; documents shorter than the span
lose nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Chunk, Frame, U, bytes_of, doc_ids, remove_repeats
from .common import quoted

SPAN = 50
#: Bytes an anchor covers, and half of the rest of a span.
GRAM = 16
SIDE = (SPAN - GRAM) // 2
#: Contexts whose suffixes are sorted at once.
LIMIT = 1 << 14


def load(table: pa.Table) -> tuple[Chunk, bytes]:
    data, bounds = bytes_of(table)
    return Chunk(doc_ids(table), data, bounds, GRAM, SPAN), data.tobytes()


def context(source: bytes, first: np.ndarray, last: np.ndarray):
    return (source[a:b] for a, b in zip(first.tolist(), last.tolist()))


#: Bytes of the first ranks: 9 bits each fit in one integer.
FIRST = 7
#: Bytes to which suffixes are put in order, at least the span.
DEPTH = 56


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks in order."""
    return np.unique(keys, return_inverse=True)[1].reshape(keys.shape).astype(np.uint32)


def later(rank: np.ndarray, by: int) -> np.ndarray:
    """The rank of the suffix that starts `by` bytes later; 0 beyond the end of a row."""
    out = np.zeros_like(rank)
    if by < rank.shape[1]:
        out[:, : rank.shape[1] - by] = rank[:, by:]
    return out


class Suffixes:
    """Suffix order of rows of symbols (0 after the end of a row, bytes from 1 on), to DEPTH bytes.

    order: suffixes that hold `least` bytes, as row * width + column, in suffix order.
    lcp[i]: bytes that order[i - 1] and order[i] share, DEPTH at most.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray, least: int):
        n, width = text.shape
        first = np.zeros((n, width), U)
        for k in range(FIRST):
            first = first << U(9) | later(text, k).astype(U)
        # a rank of 0 is kept for the end of a row
        levels = [(FIRST, ranks(np.append(first.ravel(), U(0)))[:-1].reshape(n, width))]
        starts = np.flatnonzero((np.arange(width)[None, :] + least <= size[:, None]).ravel())
        while True:
            by, rank = levels[-1]
            pair = rank.astype(U) << U(32) | later(rank, by).astype(U)
            if 2 * by >= DEPTH:
                break
            levels.append((2 * by, ranks(np.append(pair.ravel(), U(0)))[:-1].reshape(n, width)))
        self.order = starts[np.argsort(pair.ravel()[starts])]
        self.lcp = self.common(levels, first, size)

    def common(self, levels: list, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        a, b, width = self.order[:-1], self.order[1:], first.shape[1]
        shared = np.zeros(len(a), np.int64)
        room = np.minimum(np.minimum(size[a // width] - a % width, size[b // width] - b % width), DEPTH)
        for by, rank in reversed(levels):
            flat = rank.ravel()
            while True:
                inside = np.flatnonzero(shared + by <= room)
                same = inside[flat[a[inside] + shared[inside]] == flat[b[inside] + shared[inside]]]
                if not len(same):
                    break
                shared[same] += by
        flat, inside = first.ravel(), np.flatnonzero(shared < room)
        x, y = flat[a[inside] + shared[inside]], flat[b[inside] + shared[inside]]
        for k in range(FIRST):
            shift = U(9 * (FIRST - 1 - k))
            same = ((x >> shift) == (y >> shift)) & ((x >> shift & U(511)) > 0)
            shared[inside[same]] += 1
            inside, x, y = inside[same], x[same], y[same]
        return np.concatenate(([0], shared))


def previous_factors(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For suffixes in suffix order, of documents doc and with lcp to the one before: the bytes shared with
    the nearest suffix before it of a smaller document. Shares below `least` are not followed and count 0.

    Each suffix points to a candidate before it, with the least lcp on the way. Everything between is
    of no smaller document than the candidate's, so a candidate that is not smaller hands on its own:
    all suffixes jump at once, and the ways double."""
    at, low = np.arange(len(doc)) - 1, lcp.copy()
    live = np.flatnonzero(low >= least)
    found = np.zeros(len(doc), np.int64)
    while len(live):
        smaller = doc[at[live]] < doc[live]
        found[live[smaller]] = low[live[smaller]]
        live = live[~smaller]
        step = at[live]
        new_low, new_at = np.minimum(low[live], low[step]), at[step]
        low[live], at[live] = new_low, new_at
        live = live[new_low >= least]
    return found


def longest_previous_factors(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factor of each suffix in suffix order, if it is `least` or more, else 0."""
    if not len(doc):
        return np.zeros(0, np.int64)
    after = np.concatenate(([0], lcp[1:][::-1]))
    return np.maximum(previous_factors(doc, lcp, least), previous_factors(doc[::-1], after, least)[::-1])


def may_match(contexts: list[bytes]) -> np.ndarray:
    """Numbers of the contexts that may share 50 bytes with another one. These hold the anchor at the same
    place, so half of what is beside the anchor lies on one side of it: the contexts agree in the anchor
    with the SIDE bytes before it or with the SIDE bytes after it. The first byte of a context
    tells how many bytes lie before its anchor."""
    before = [c[1 + c[0] - SIDE : 1 + c[0] + GRAM] if c[0] >= SIDE else i for i, c in enumerate(contexts)]
    after = [c[1 + c[0] : 1 + c[0] + GRAM + SIDE] for c in contexts]
    left, right = Counter(before), Counter(after)
    return np.flatnonzero([left[a] > 1 or right[b] > 1 for a, b in zip(before, after)])


def earlier_matches(contexts: list[bytes], owner: np.ndarray) -> np.ndarray:
    """Bit s of each: its 50 bytes from s on also occur in a context of a smaller owner."""
    bits = np.zeros(len(contexts), U)
    some = may_match(contexts)
    bits[some] = matches_in_order([contexts[i] for i in some], owner[some])
    return bits


def matches_in_order(contexts: list[bytes], owner: np.ndarray) -> np.ndarray:
    """earlier_matches by the suffix order of the contexts."""
    n = len(contexts)
    by_doc = np.argsort(owner, kind="stable")
    size = np.fromiter((len(contexts[i]) - 1 for i in by_doc), np.int64, n)
    width = int(size.max(initial=0))
    text = np.zeros((n, width), np.uint16)
    text[np.arange(width)[None, :] < size[:, None]] = np.frombuffer(b"".join([contexts[i][1:] for i in by_doc]), np.uint8).astype(np.uint16) + 1
    bits = np.zeros(n, U)
    if width >= SPAN:
        suffixes = Suffixes(text, size, SPAN)
        row, column = suffixes.order // width, suffixes.order % width
        late = longest_previous_factors(owner[by_doc][row], suffixes.lcp, SPAN) >= SPAN
        np.bitwise_or.at(bits, by_doc[row[late]], U(1) << column[late].astype(U))
    return bits


def digest(table: pa.Table, chunk: Chunk, source: bytes, removed: np.ndarray) -> pa.Table:
    gone, spans, shas = [], [], []
    for a, b in zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist()):
        own, out = chunk.values[a:b], removed[a:b]
        n = int(np.count_nonzero(out))
        gone.append(n)
        spans.append(int(np.count_nonzero(out[1:] & ~out[:-1])) + int(out[0]) if n else 0)
        shas.append(hashlib.sha256(own[~out] if n else own).hexdigest())
    return pa.table({
        "doc_id": table.column("doc_id"),
        "n_bytes": np.diff(chunk.bounds),
        "n_removed": pa.array(gone, pa.int64()),
        "n_spans": pa.array(spans, pa.int64()),
        "kept_sha256": pa.array(shas, pa.string()),
    })


def repeat_digests(docs: DataFrame) -> DataFrame:
    frame = Frame(load, context, earlier_matches, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return remove_repeats(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), frame, LIMIT)


def remaining(table: pa.Table, chunk: Chunk, source: bytes, removed: np.ndarray) -> pa.Table:
    """The rest of each row with the text that is left. A run may end inside a
    character; what is left of such a character goes too."""
    left = []
    for i, (a, b) in enumerate(zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist())):
        out = removed[a:b]
        left.append(chunk.values[a:b][~out].tobytes().decode("utf-8", "ignore") if out.any() else None)
    changed = pa.array([x is not None for x in left])
    text = pc.if_else(changed, pa.array(left, pa.string()), table.column("text").combine_chunks())
    return pa.table({"doc": table.column("doc"), "text": text})


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes removed from text, n_chars (if there) counted anew,
    and all other columns as they were. Null text stays null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*quoted([c for c in docs.columns if c != "text"])).alias("doc"))
    frame = Frame(load, context, earlier_matches, remaining, rows.select("doc", "text").schema)
    found = remove_repeats(rows, frame, LIMIT)
    columns = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    kept = {c: F.col("doc")[c] for c in docs.columns if c != "text"}
    return found.select(*[columns.get(c, kept.get(c)).alias(c) for c in docs.columns])
