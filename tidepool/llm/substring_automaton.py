"""Removal of repeated word windows with suffix automata of reference shards.

A word goes if it lies in a window of 13 words that also starts in a document with
a smaller doc_id. Anchors (see anchors.py) cut the corpus into reference shards of
bounded size that hold every context in which a window of theirs can match, so
each shard's automaton lives in the task that streams the shard's documents, and
none has to be sent to all tasks. In a shard contexts come by doc_id: a context
is streamed through the automaton of the documents before it for its matching
statistics, windows whose statistic reaches 13 are removed, and only then is the
context added to the automaton.

Defined results: words are maximal runs of other bytes than space and
\\t\\n\\v\\f\\r, unchanged; null text has none; a null doc_id counts as the largest
id; rows with the same doc_id never match each other; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import FACTOR, INVERSE, Chunk, Frame, U, bytes_of, doc_ids, mixed, remove_repeats

SPAN = 13
#: Words an anchor covers.
GRAM = 5
#: Contexts of one automaton.
LIMIT = 1 << 12
SEGMENT = 1 << 20
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([U(1)], np.full(max(n - 1, 0), U(base & (1 << 64) - 1)))), dtype=U)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each word by polynomial prefix sums over segments of whole words."""
    out, at = np.empty(len(first), U), 0
    size = int(max(SEGMENT, (last - first).max(initial=0))) + 1
    up, down = powers(FACTOR, size), powers(INVERSE, size)
    while at < len(first):
        base = first[at]
        to = max(at + 1, int(np.searchsorted(last, base + size, side="left")))
        part = data[base : last[to - 1]].astype(U) + U(1)
        total = np.concatenate(([U(0)], np.cumsum(part * up[: len(part)], dtype=U)))
        a, b = first[at:to] - base, last[at:to] - base
        out[at:to] = mixed((total[b] - total[a]) * down[a])
        at = to
    return out


def load(table: pa.Table) -> tuple[Chunk, tuple]:
    data, bounds = bytes_of(table)
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))[: len(word)]))
    last = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True]))[: len(word)])) + 1
    chunk = Chunk(doc_ids(table), word_hashes(data, first, last), np.searchsorted(first, bounds), GRAM, SPAN)
    return chunk, (data.tobytes(), first, last)


def context(source: tuple, first: np.ndarray, last: np.ndarray):
    """Words joined by one space, which no word holds."""
    raw, begins, ends = source
    return (b" ".join(raw[a:b].split()) for a, b in zip(begins[first].tolist(), ends[last - 1].tolist()))


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]

    def state(self, size: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def split(self, at: int, word: bytes, to: int) -> int:
        """The state for the suffixes of `to` that end the step from `at`."""
        if self.size[to] == self.size[at] + 1:
            return to
        twin = self.state(self.size[at] + 1, dict(self.next[to]))
        self.link[twin] = self.link[to]
        self.link[to] = twin
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            to = self.next[last].get(word)
            if to is not None:
                last = self.split(last, word, to)
                continue
            new, at = self.state(self.size[last] + 1, {}), last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            self.link[new] = self.split(at, word, self.next[at][word]) if at >= 0 else 0
            last = new

    def statistics(self, words: list[bytes]) -> list[int]:
        """Length of the longest match that ends at each word."""
        at = size = 0
        out = []
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                size = self.size[at]
            to = self.next[at].get(word)
            if to is not None:
                at, size = to, size + 1
            out.append(size)
        return out


def earlier_windows(contexts: list[bytes], owner: np.ndarray) -> np.ndarray:
    """Bit s of each: its window from word s on also occurs in a context of a smaller owner."""
    automaton, bits = Automaton(), np.zeros(len(contexts), U)
    order = np.argsort(owner, kind="stable").tolist()
    waiting: list[list[bytes]] = []
    now = None
    for i in order:
        if owner[i] != now:
            for words in waiting:
                automaton.add(words)
            waiting, now = [], owner[i]
        words = contexts[i][1:].split(b" ")
        found = 0
        for end, size in enumerate(automaton.statistics(words)):
            if size >= SPAN:
                found |= 1 << (end - SPAN + 1)
        bits[i] = found
        if found != (1 << (len(words) - SPAN + 1)) - 1:
            waiting.append(words)
    return bits


def digest(table: pa.Table, chunk: Chunk, source: tuple, removed: np.ndarray) -> pa.Table:
    raw, first, last = source
    gone = np.concatenate(([0], np.cumsum(removed)))
    shas = []
    for a, b in zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist()):
        if gone[a] == gone[b]:
            kept = b" ".join(raw[first[a] : last[b - 1]].split()) if b > a else b""
        else:
            at = np.flatnonzero(~removed[a:b]) + a
            kept = b" ".join([raw[s:e] for s, e in zip(first[at].tolist(), last[at].tolist())])
        shas.append(hashlib.sha256(kept).hexdigest())
    return pa.table({"doc_id": table.column("doc_id"), "n_words": np.diff(chunk.bounds), "n_removed": np.diff(gone[chunk.bounds]), "kept_sha256": pa.array(shas, pa.string())})


def window_digests(docs: DataFrame) -> DataFrame:
    frame = Frame(load, context, earlier_windows, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return remove_repeats(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), frame, LIMIT)
