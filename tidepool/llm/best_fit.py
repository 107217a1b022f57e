"""Packing of token pieces into sequences by exact complements, then best fit.

Only lengths from 1 to the capacity occur, so the plan needs just the number of
pieces of each length, whatever the corpus holds. The plan is a list of patterns
(runs of lengths and how often the pattern is used). From the longest length
down, the gap beside a piece is looked up among single lengths, sums of two and
sums of three that fill it exactly and are still available; a pattern is used as
often as its scarcest length allows. Lengths that no sum completes are packed by
best fit: the largest available piece that fits, again and again.

Pieces are numbered within their length by counts per task and a prefix sum over
tasks, and a pattern owns a range of these numbers. So the place of each piece
follows from a lookup, and no length's pieces meet in one task.

Defined results: null or empty text is one piece that holds only the end id;
longer documents than the capacity are cut; repeated rows are packed each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 2048
END = 0
#: Words whose ids a worker remembers before it starts afresh.
CACHE_ENTRIES = 1_000_000
#: Marks that close a word and form one run.
MARKS = b".,;:!?"
SHIFT = np.int64(1 << 40)


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit integers. The tokenizer drops
    white space and never looks across it, so ids are remembered by word.

    New words are encoded many at a time, as one text. Letters with at most one run of
    closing marks have one or two ids that end a word, which tells them apart again; the
    count is checked, and other words are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def add(self, words: list[bytes]) -> None:
        plain, sizes, other = [], [], []
        for w in words:
            if w.isalpha():
                plain.append(w)
                sizes.append(1)
            elif (bare := w.rstrip(MARKS)).decode().isalpha():
                plain.append(w)
                sizes.append(1 if len(bare) == len(w) else 2)
            else:
                other.append(w)
        for lo in range(0, len(plain), 1024):
            own = plain[lo : lo + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(own).decode()], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids])
            last = np.cumsum(sizes[lo : lo + 1024]) - 1
            if len(at) != last[-1] + 1:
                other += own
                continue
            to = (4 * (at[last] + 1)).tolist()
            raw = ids.tobytes()
            self.known.update(zip(own, [raw[a:b] for a, b in zip([0, *to], to)]))
        found = self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
        self.known.update(zip(other, [array("I", f.ids).tobytes() for f in found]))

    def texts(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode().split() for t in texts]
        words = set().union(*split)
        missing = words.difference(self.known)
        if len(self.known) + len(missing) > CACHE_ENTRIES:
            self.known.clear()
            missing = words
        self.add(list(missing))
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in split]


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's tokenizer; later tasks of the worker find its words again."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; part and number place a
    piece among those of its length: number counts them within the task part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen, part = word_ids(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                at, piece, start, length, crc = [], [], [], [], []
                for i, raw in enumerate(ids_of.texts(rows.column("text").to_pylist())):
                    raw += end
                    for k in range(0, len(raw), 4 * capacity):
                        own = raw[k : k + 4 * capacity]
                        at.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                ranked = size[order]
                first = np.searchsorted(ranked, ranked)
                number = np.empty(len(size), np.int64)
                number[order] = seen[ranked] + np.arange(len(size)) - first
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(number), pa.array(np.full(len(size), part, np.int64))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "number", "part"],
                )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, number long, part long"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


class Stock:
    """Pieces left of each length."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left, self.capacity = counts.astype(np.int64).copy(), capacity
        self.patterns: list[tuple[int, list[tuple[int, int]]]] = []

    def use(self, runs: dict[int, int]) -> None:
        """Take a pattern (length -> copies) as often as there are pieces for it."""
        times = min(int(self.left[n]) // k for n, k in runs.items())
        for n, k in runs.items():
            self.left[n] -= times * k
        self.patterns.append((times, sorted(runs.items(), reverse=True)))

    def pair(self, total: int, most: int, left: np.ndarray) -> tuple[int, int] | None:
        """The most plentiful two lengths of at most most that add up to total."""
        a = np.arange((total + 1) // 2, min(most, total - 1) + 1)
        if not len(a):
            return None
        both = np.where(a == total - a, left[a] // 2, np.minimum(left[a], left[total - a]))
        best = int(both.argmax())
        return (int(a[best]), int(total - a[best])) if both[best] else None

    def complement(self, n: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap beside a piece of length n."""
        left = self.left.copy()
        left[n] -= 1
        if gap <= n and left[gap]:
            return (gap,)
        found = self.pair(gap, n, left)
        if found:
            return found
        for a in np.flatnonzero(left[: min(n, gap - 2) + 1])[::-1].tolist():
            if 3 * a < gap:
                break
            left[a] -= 1
            found = self.pair(gap - a, a, left)
            left[a] += 1
            if found:
                return (a, *found)
        return None

    def exact(self) -> None:
        for n in range(self.capacity, 0, -1):
            while self.left[n]:
                gap = self.capacity - n
                found = self.complement(n, gap) if gap else ()
                if found is None:
                    break
                runs = {n: 1}
                for x in found:
                    runs[x] = runs.get(x, 0) + 1
                self.use(runs)

    def best_fit(self) -> None:
        for n in range(self.capacity, 0, -1):
            while self.left[n]:
                left, runs, gap, most = self.left.copy(), {}, self.capacity, n
                while True:
                    fits = np.flatnonzero(left[: min(most, gap) + 1])
                    if not len(fits):
                        break
                    most = int(fits[-1])
                    copies = min(int(left[most]), gap // most)
                    runs[most] = copies
                    left[most] = 0
                    gap -= copies * most
                self.use(runs)


def plan_patterns(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(length, copies)]) that use up counts[length] pieces."""
    stock = Stock(counts, capacity)
    stock.exact()
    stock.best_fit()
    return stock.patterns


def slot_table(patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> np.ndarray:
    """Rows (length << 40 | first number, first sequence, copies, offset), sorted."""
    rows, next_number, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for times, runs in patterns:
        offset = 0
        for n, copies in runs:
            rows.append((int(SHIFT) * n + int(next_number[n]), sequence, copies, offset))
            next_number[n] += times * copies
            offset += n * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (length, number, part and others) with sequence_id and offset."""
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = by_part.select("part", "length", before.alias("first"))
    counts = np.zeros(capacity + 1, np.int64)
    for n, many in by_part.groupBy("length").agg(F.sum("n")).collect():  # one row for each of capacity lengths at most
        counts[n] = many
    slots = slot_table(plan_patterns(counts, capacity), capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            size = cols["length"].to_numpy(zero_copy_only=False)
            number = cols["number"].to_numpy(zero_copy_only=False) + cols.pop("first").to_numpy(zero_copy_only=False)
            key = size * SHIFT + number
            slot = slots[np.searchsorted(slots[:, 0], key, side="right") - 1] if len(size) else np.zeros((0, 4), np.int64)
            at = key - slot[:, 0]
            cols["sequence_id"] = pa.array(slot[:, 1] + at // np.maximum(slot[:, 2], 1))
            cols["offset"] = pa.array(slot[:, 3] + at % np.maximum(slot[:, 2], 1) * size)
            cols.pop("number"), cols.pop("part")
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    kept = [f"{c} {t}" for c, t in pieces.dtypes if c not in ("number", "part")]
    joined = pieces.join(firsts, ["part", "length"]).select(*pieces.columns, "first")
    return joined.mapInArrow(run, ", ".join([*kept, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    return place(materialize(cut_pieces(docs, path, capacity), "pieces"), capacity)
