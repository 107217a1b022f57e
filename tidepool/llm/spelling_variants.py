"""Spelling variants through a reduced alphabet.

Letters are hashed to SYMBOLS symbols. If two words differ by one inserted, deleted or replaced letter, then one's
reduced word lies in the full one-edit neighbourhood of the other's: the reduced word itself, and every deletion,
replacement and insertion over the few symbols. Each word generates that neighbourhood, joins it with the reduced
vocabulary, and what meets is verified on the original strings.

Reduced words are 64-bit polynomial hashes, so each neighbour takes constant time from prefix and suffix sums,
however long the word is; equal reduced words always meet, and others that meet by chance fail the verification.
Insertions beside an equal symbol and deletions inside a run of equal symbols repeat others and are left out. Words travel as numbers
until they are verified. Neighbourhoods are generated over slices of positions, so memory is bounded.

Counting takes whole texts. A task adds up its words and sends them on when it holds HELD of them.

A word's form is its near word of the largest count; counts at least double along forms, so the chain to the
root is no longer than the logarithm of the largest count. Roots come from doubled steps.

Defined results: null text has no words; a null doc_id reads as the empty text in the hashed key; repeated rows count again;
ties between forms go to the smallest word in code-point order; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

RUN = re.compile("[a-zÀ-ÿ]+")
#: One in NOISE runs of a document loses a letter.
NOISE = 97
LETTERS = 5
OCCURRENCES = 3
FACTOR = 2
SYMBOLS = 8
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
HELD = 500_000
#: Letters whose neighbourhoods are generated at once, and words of a batch.
SLICE = 1 << 15
BATCH = 1 << 13
#: Reduced words that are broadcast at most; more are shuffled.
FEW = 1 << 20


def spelled(run: str, key: int) -> str:
    """run, without one of its letters if its key is chosen."""
    h = zlib.crc32(run.encode(), key)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words_of(doc_id: int | None, text: str | None, letters: int) -> Iterator[tuple[str, int]]:
    runs = Counter(RUN.findall((text or "").encode().lower().decode()))
    key = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        if len(run) >= letters:
            word = spelled(run, key)
            if len(word) >= letters:
                yield word, n


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """id, word and n of the words of docs (doc_id, text), stored."""

    def sent(found: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for word, n in words_of(doc_id, text, letters):
                        found[word] = found.get(word, 0) + n
                    if len(found) >= HELD:
                        yield sent(found)
                        found = {}
        yield sent(found)

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.where(F.col("n") >= occurrences).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


class Reduced:
    """Words as symbols 1 to SYMBOLS and the hashes of their reduced words (sum of symbol * BASE**position)."""

    def __init__(self, words: list[str]):
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.owner = np.repeat(np.arange(len(words)), size)
        self.at = np.arange(len(letters)) - self.start[self.owner]
        # Multiplicative hashing of the code point: its top bits pick the symbol.
        self.symbol = (letters.astype(np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32) * np.uint64(SYMBOLS) >> np.uint64(32)) + np.uint64(1)
        powers = np.full(int(size.max(initial=0)) + 1, BASE, np.uint64)
        powers[0] = 1
        self.power = np.cumprod(powers, dtype=np.uint64)
        term = self.symbol * self.power[self.at]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
        self.before = sums[:-1] - sums[self.start[self.owner]]
        self.whole = sums[self.start[1:]] - sums[self.start[:-1]]
        self.size = size

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, hashes of its neighbours), each neighbour once."""
        every = np.arange(len(self.size))
        yield every, self.whole
        for symbol in range(1, SYMBOLS + 1):
            last = self.start[1:] - 1
            new = (self.size == 0) | (self.symbol[np.maximum(last, 0)] != symbol) if len(self.symbol) else self.size == 0
            yield every[new], (self.whole + np.uint64(symbol) * self.power[self.size])[new]
        for lo in range(0, len(self.symbol), SLICE):
            part = slice(lo, lo + SLICE)
            owner, own, before = self.owner[part], self.symbol[part], self.before[part]
            power = self.power[self.at[part]]
            first = self.at[part] == 0
            previous = np.where(first, 0, self.symbol[np.arange(lo, lo + len(own)) - 1])
            rest = self.whole[owner] - before
            changed = own != previous
            yield owner[changed], (before + (rest - own * power) * np.uint64(BASE_INVERSE))[changed]
            for symbol in range(1, SYMBOLS + 1):
                s = np.uint64(symbol)
                other = own != s
                yield owner[other], (self.before[part] + rest + (s - own) * power)[other]
                new = previous != s
                yield owner[new], (before + s * power + rest * np.uint64(BASE))[new]


def neighbourhoods(words: DataFrame) -> DataFrame:
    """(id, key): the keys of each word's neighbourhood; words (id, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                for owner, keys in Reduced(part.column("word").to_pylist()).neighbours():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(keys.view(np.int64))], names=["id", "key"])

    return words.select("id", "word").mapInArrow(run, "id long, key long")


def reduced(words: DataFrame) -> DataFrame:
    """(other, key): the key of each word's own reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = Reduced(batch.column("word").to_pylist()).whole
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys.view(np.int64))], names=["other", "key"])

    return words.select("id", "word").mapInArrow(run, "other long, key long")


def one_edit(a: str, b: str) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """id, word, n of each word with near, near_n of each near word; both directions. words as of `vocabulary`."""
    own = reduced(words)
    if words.limit(FEW + 1).count() <= FEW:
        own = F.broadcast(own)
    met = neighbourhoods(words).join(own, "key").where("id != other").select("id", "other")
    named = met.join(words, "id").join(words.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n")), "other")
    return named.where(one_edit("word", "near")).dropDuplicates(["id", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of forms (id, form), whose chains have an end: each round doubles the steps taken."""
    now = materialize(forms.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        stepped = materialize(now.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        went = stepped.where("went").limit(1).count()
        discard(now)
        now = stepped.drop("went")
        if not went:
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs."""
    words = vocabulary(docs)
    pairs = near_pairs(words)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"), F.col("other").alias("id"))).alias("best")
    found = materialize(pairs.groupBy("id", "n").agg(F.count("*").alias("n_near"), best), "near")
    strong = -F.col("best.n") >= FACTOR * F.col("n")
    forms = found.where(strong).select("id", F.col("best.id").alias("form_id"))
    ends = roots(forms).join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    form = found.select("id", "n_near", F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n"))
    all_ = words.join(form, "id", "left").join(ends, "id", "left")
    return all_.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


#: crc32 is affine: the checksum of zeros of the same length, xored with one table value for each byte and its distance from the end.
ORACLE_SQL = r"""
    WITH RECURSIVE bits(b, v, k) AS (
        SELECT b, b::BIGINT, 0 FROM range(256) t(b)
        UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
    byte AS (SELECT b, v FROM bits WHERE k = 8),
    runs AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
    keyed AS MATERIALIZED (
        SELECT row_number() OVER () AS r, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs WHERE length(run) >= 5),
    far(d, b, v) AS (
        SELECT 0, b, v FROM byte
        UNION ALL SELECT d + 1, far.b, xor(far.v >> 8, byte.v) FROM far JOIN byte ON byte.b = far.v & 255 WHERE d < (SELECT max(length(h)) // 2 FROM keyed)),
    zeros(len, v) AS (
        SELECT 0, 4294967295::BIGINT
        UNION ALL SELECT len + 1, xor(zeros.v >> 8, byte.v) FROM zeros JOIN byte ON byte.b = zeros.v & 255 WHERE len < (SELECT max(length(h)) // 2 FROM keyed)),
    bytes AS (SELECT r, len - i - 1 AS d, ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT AS b FROM (SELECT r, h, length(h) // 2 AS len, unnest(range(length(h) // 2)) AS i FROM keyed)),
    parts AS (SELECT r, bit_xor(v) AS v FROM bytes JOIN far USING (d, b) GROUP BY r),
    hashed AS (
        SELECT run, n, xor(xor(parts.v, zeros.v), 4294967295) AS crc FROM keyed JOIN parts USING (r) JOIN zeros ON zeros.len = length(h) // 2),
    words AS MATERIALIZED (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT CASE WHEN crc % 97 = 0 THEN run[: crc % length(run)] || run[crc % length(run) + 2 :] ELSE run END AS word, n FROM hashed)
        WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    cut AS (SELECT word, n, i, word[: i] || word[i + 2 :] AS c FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    shorter AS (SELECT DISTINCT cut.word, cut.n, words.word AS other, words.n AS m FROM cut JOIN words ON words.word = cut.c),
    near AS (
        SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (i, c) WHERE a.word <> b.word
        UNION ALL SELECT word, n, other, m FROM shorter UNION ALL SELECT other, m, word, n FROM shorter),
    best AS (
        SELECT word, n, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word, n),
    form AS (SELECT word, n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM best),
    walk(word, root) AS (
        SELECT word, word FROM words UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.root WHERE form.form IS NOT NULL),
    ends AS (SELECT walk.word, walk.root FROM walk LEFT JOIN form ON form.word = walk.root WHERE form.form IS NULL)
    SELECT words.word, form.form, ends.root, words.n, coalesce(form.n_near, 0) AS n_near, form.form_n
    FROM words LEFT JOIN form USING (word) JOIN ends USING (word)
"""
