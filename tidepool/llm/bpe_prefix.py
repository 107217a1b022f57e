"""Exact BPE encoding and decoding by dynamic programming over prefixes.

For byte-level BPE every prefix of a pre-token has one encoding, and the
encoding of a prefix is the encoding of a shorter prefix plus one last token.
So one integer a prefix is enough: the automaton of all vocabulary entries
reports the entries that end at a position, and the one that is compatible with
the last token of the prefix before it is stored. Following the stored tokens
back from the end gives the ids.

Two tokens are compatible if merging never joins symbols across their boundary.
Inside a token the symbol at its edge changes only when a merge of the token's
own merge tree fires, so each edge has a timeline of (symbol, rank that made it,
rank that ends it). A merge across the boundary needs a pair that is present on
both timelines just before its rank.

Defined results: null or empty text gives no ids; texts of any length are encoded
whole; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pre-token pattern of byte-level tokenizers, which their files name but do not hold.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units and pre-tokens a worker remembers before it starts afresh.
CACHE_ENTRIES = 300_000
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the other bytes take code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.raw: dict[int, bytes] = {}
        for token, i in vocab.items():
            self.raw[i] = bytes(letters[c] for c in token)
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = r
            parts.setdefault(made, (a, b, r))
        self.parts = parts
        self.edges: tuple[dict, dict] = ({}, {})
        self.known: dict[int, bool] = {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.raw |= {i: s.encode() for s, i in self.special.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.automaton = ahocorasick.Automaton()
        for i, raw in self.raw.items():
            if raw and i not in self.special.values():
                self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.automaton.make_automaton()
        self.pretokens: dict[str, list[int]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Timeline of the symbol at the left (0) or right (1) edge of a token."""
        found = self.edges[side].get(token)
        if found is None:
            found, ends, at = [], NEVER, token
            while True:
                a = self.parts.get(at)
                found.append((at, -1 if a is None else a[2], ends))
                if a is None:
                    break
                at, ends = a[side], a[2]
            self.edges[side][token] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        found, rank, right = True, self.rank, self.edge(b, 0)
        for x, made_x, ends_x in self.edge(a, 1):
            for y, made_y, ends_y in right:
                r = rank.get((x, y))
                # equal ranks: the leftmost pair merges first
                if r is not None and made_x < r < ends_x and made_y < r <= ends_y:
                    found = False
                    break
            if not found:
                break
        if len(self.known) > 2 * CACHE_ENTRIES:
            self.known.clear()
        self.known[a << 20 | b] = found
        return found

    def encode_pretoken(self, piece: str) -> list[int]:
        s = piece.encode("utf-8").decode("latin-1")
        n = len(s)
        last, known = [-1] * (n + 1), self.known
        size = [0] * (n + 1)
        for at, (token, length) in self.automaton.iter(s):
            start = at + 1 - length
            if last[at + 1] < 0:
                if start:
                    before = last[start]
                    fits = known.get(before << 20 | token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if not fits:
                        continue
                last[at + 1], size[at + 1] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.special_pattern.split(text) if self.special_pattern and "<" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.pattern.findall(part):
                ids = self.pretokens.get(piece)
                if ids is None:
                    if len(self.pretokens) > CACHE_ENTRIES:
                        self.pretokens.clear()
                    ids = self.encode_pretoken(piece)
                    if len(piece) < 64:
                        self.pretokens[piece] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.raw[i] for i in ids])


#: A single space or line feed between two characters that aren't white space
#: starts a new pre-token, so a text can be cut there and the parts remembered.
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
OTHER_SPACE = re.compile(r"\s\s")


class Units(dict):
    """Part of a text -> (number of ids, ids as text, decoded bytes)."""

    def __init__(self, encoder: PrefixEncoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, part: str) -> tuple[int, str, bytes]:
        ids = self.encoder.encode(part if part[:1] == "\n" else self.lead + part)
        found = (len(ids), ",".join(map(str, ids)), self.encoder.decode(ids))
        if len(part) < 64:
            if len(self) > 2 * CACHE_ENTRIES:
                self.clear()
            self[part] = found
        return found


def cut(text: str) -> list[str]:
    """Parts of a text. A part after the first one stands for itself if it starts
    with a line feed, and else has lost the space before it."""
    if OTHER_SPACE.search(text):
        return SINGLE_SPACE.split(text)
    return text.replace("\n", " \n").split(" ")


_UNITS: dict[str, tuple[Units, Units]] = {}


def worker_units(path: str) -> tuple[Units, Units]:
    """This worker's caches; later tasks of the worker find their entries again."""
    if path not in _UNITS:
        encoder = PrefixEncoder(path)
        _UNITS[path] = Units(encoder, ""), Units(encoder, " ")
    return _UNITS[path]


def digest_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    first, later = worker_units(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            counts, id_shas, text_shas = [], [], []
            for text in part.column("text").to_pylist():
                units = cut(text or "")
                head, units[0] = first[units[0]], ""
                sizes, ids, raw = zip(head, *map(later.__getitem__, units[1:]))
                counts.append(sum(sizes))
                id_shas.append(hashlib.sha256(",".join(filter(None, ids)).encode()).hexdigest())
                decoded = b"".join(raw).decode("utf-8", "replace")
                text_shas.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_shas, pa.string()), pa.array(text_shas, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: number of ids and digests of ids and of their decoding."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lambda it: digest_batches(it, path), schema)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the array of ids of each whole text."""

    def run(batches):
        encoder = worker_units(path)[0].encoder
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
