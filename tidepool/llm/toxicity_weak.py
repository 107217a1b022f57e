"""Toxicity scores by weak supervision.

Voters are lexicon entries (whole words) and patterns (word beginnings) that a bounded
sample of labelled training rows ties to the toxic label. The labels choose the voters
and give their first accuracies; they don't vote. A generative label model takes the true
class of a document as hidden and sees the voters' votes alone. A voter fires or abstains.
Voters whose votes are correlated within the toxic class form a clique, and a clique has a table of
parameters for each class: the chance that none, one, two or more of its voters fire. So a
word and its own beginning count once, not twice. Expectation maximisation fits the
tables, and the posterior labels, not the given ones, train a sparse linear classifier
over words and word beginnings, which scores every whole text.

Only the text enters a score. Rows of the held-out third are no training rows.

Defined results: null, empty or wordless text gets the score of no features; a
document with several labels counts with the highest; without training rows of both
classes every score is 0; repeated rows score alike; a null doc_id is not held out and trains nothing; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted

#: Labelled training rows of the sample at most.
LABELLED = 6000
#: Toxic rows of the sample that a voter needs, and that a feature of the classifier needs as a
#: share of all toxic rows, between two bounds.
MIN_ROWS = 3
LEAN_SHARE, LEAN_LEAST, LEAN_MOST = 0.015, 3, 8
#: Least lower confidence bound (about 95 %) of a voter's share of toxic rows, strictest first, and the
#: share of toxic rows that some voter should reach.
PRECISION = (0.7, 0.6, 0.5)
COVER = 0.9
Z = 1.645
CORRELATED = 0.7
#: Firing voters of a clique that its tables tell apart.
FIRED = 3
#: Rows added to each table entry of the toxic class, and share of the clean rows added to the clean
#: one's: a voter is taken to have fired in that many more clean rows than were seen.
SMOOTH = 0.05
DOUBT_SHARE = 7.5e-4
ROUNDS = 20
STEPS = 1000
#: Least share of toxic rows among a feature's rows, to be looked at.
MIN_SHARE = 0.3
#: A feature's share of toxic posterior among its rows, to enter the classifier.
LEAN = 0.7
PENALTY = 5e-5
THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def features(text: str | None) -> set[str]:
    """Distinct lower-case words, and beginnings of words, marked by a star."""
    words = set(WORD.findall((text or "").lower()))
    found = set(words)
    for n in PREFIXES:
        found.update([w[:n] + "*" for w in words if len(w) > n])
    return found


class Sample:
    """Rows of distinct features as one index array; label is 1 or 0."""

    def __init__(self, rows: list[tuple[list[str], int]]):
        self.names = sorted({f for own, _ in rows for f in own})
        number = {f: i for i, f in enumerate(self.names)}
        own = [[number[f] for f in r] for r, _ in rows]
        self.label = np.array([y for _, y in rows], np.int64)
        self.row = np.repeat(np.arange(len(own)), [len(o) for o in own])
        self.feature = np.array([i for o in own for i in o], np.int64)

    def totals(self, weight: np.ndarray) -> np.ndarray:
        """Sum over rows of each feature's row weights."""
        return np.bincount(self.feature, weight[self.row], len(self.names))


def lower_bound(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lower confidence bound of a share (Wilson)."""
    n = np.maximum(n, 1)
    share = hits / n
    spread = Z * np.sqrt(share * (1 - share) / n + (Z / (2 * n)) ** 2)
    return (share + Z * Z / (2 * n) - spread) / (1 + Z * Z / n)


def vote_table(sample: Sample) -> np.ndarray:
    """Rows x voters, 1 where a voter fires. Features that fire alike are one voter. The strictest bound
    of PRECISION whose voters reach COVER of the toxic rows chooses them, else the loosest."""
    truth = sample.label == 1
    toxic, clean = sample.totals(truth * 1.0), sample.totals(~truth * 1.0)
    sure = np.where(toxic >= MIN_ROWS, lower_bound(toxic, toxic + clean), 0)
    for least in PRECISION:
        chosen = sure >= least
        reached = np.zeros(len(truth), bool)
        reached[sample.row[chosen[sample.feature]]] = True
        if reached[truth].mean() >= COVER:
            break
    column = np.full(len(sample.names), -1)
    column[chosen] = np.arange(chosen.sum())
    hit = column[sample.feature] >= 0
    votes = np.zeros((chosen.sum(), len(sample.label)), np.uint8)
    votes[column[sample.feature[hit]], sample.row[hit]] = 1
    return np.unique(votes, axis=0).T if len(votes) else votes.T


def cliques(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Clique number of each voter: voters correlated within the toxic class are in one."""
    own = votes[toxic].astype(np.float32)
    own -= own.mean(axis=0)
    scatter = own.T @ own
    spread = np.sqrt(np.maximum(np.diag(scatter), 1e-9))
    tied = scatter >= CORRELATED * spread[:, None] * spread[None, :]
    np.fill_diagonal(tied, True)
    label = np.arange(len(tied))
    while True:
        low = np.where(tied, label[None, :], len(tied)).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = low


def label_model(votes: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Posterior of the toxic class for each row of 0/1 votes (rows x voters).

    The labels give the prior and the first estimate of the tables; from then on they are not seen."""
    clique = cliques(votes, label == 1)
    n = int(clique.max(initial=-1)) + 1
    member = np.zeros((votes.shape[1], n), np.float32)
    member[np.arange(votes.shape[1]), clique] = 1
    fired = np.minimum(votes.astype(np.float32) @ member, FIRED).astype(np.int64)
    # that no voter at all fires is a vote of its own
    fired = np.concatenate((fired, (fired.sum(axis=1, keepdims=True) == 0)), axis=1)
    cell = fired + np.arange(n + 1) * (FIRED + 1)
    posterior = (label == 1) * 1.0
    prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
    for _ in range(ROUNDS):
        total = np.stack([(1 - posterior).sum(), posterior.sum()])
        table = np.stack([sum(np.bincount(cell[:, c], w, (n + 1) * (FIRED + 1)) for c in range(n + 1)) for w in (1 - posterior, posterior)])
        extra = np.array([[DOUBT_SHARE * total[0]], [SMOOTH]])
        chance = (table + extra) / (total[:, None] + extra)
        weight = np.log(chance[1] / chance[0])
        weight[:: FIRED + 1] = 0  # a clique that abstains says nothing
        odds = np.log(prior / (1 - prior)) + weight[cell].sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < 1e-6:
            break
    return posterior


def alike(sample: Sample, used: np.ndarray) -> np.ndarray:
    """Number of the group of each used feature, -1 for others; features of the same rows are one group."""
    rng = np.random.default_rng(0)
    mark = rng.integers(0, 1 << 63, len(sample.label), np.uint64)
    total = np.zeros(len(sample.names), np.uint64)
    np.add.at(total, sample.feature, mark[sample.row])
    group = np.full(len(used), -1)
    group[used] = np.unique(total[used], return_inverse=True)[1]
    return group


def train_linear(sample: Sample, target: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal steps, over the
    features that lean to the toxic posterior. Features of the same rows share one weight evenly."""
    n = max(len(target), 1)
    toxic, rows = sample.totals(target), sample.totals(np.ones(n))
    least = min(max(LEAN_SHARE * target.sum(), LEAN_LEAST), LEAN_MOST) - 0.5
    group = alike(sample, (toxic >= LEAN * rows) & (toxic >= least))
    many = int(group.max(initial=-1)) + 1
    cells = np.unique(sample.row[group[sample.feature] >= 0] * max(many, 1) + group[sample.feature][group[sample.feature] >= 0])
    row, column = cells // max(many, 1), cells % max(many, 1)
    totals = lambda w: np.bincount(column, w[row], many)
    sums = lambda w: np.bincount(row, w[column], n)
    size = sums(np.ones(many)) + 1
    # a diagonal that bounds the curvature, as all features are 0 or 1
    rate = 4 * n / np.maximum(totals(size), 1.0)
    bias_rate = 4 * n / size.sum()
    weight = np.zeros(many)
    ahead, bias, bias_ahead, pace = weight.copy(), 0.0, 0.0, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(sums(ahead) + bias_ahead, -30, 30)))
        gap = (p - target) / n
        new = ahead - rate * totals(gap)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        new_bias = bias_ahead - bias_rate * gap.sum()
        quick = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / quick * (new - weight)
        bias_ahead = new_bias + (pace - 1) / quick * (new_bias - bias)
        weight, bias, pace = new, new_bias, quick
    members = np.bincount(group[group >= 0], minlength=many)
    return float(bias), np.where(group >= 0, np.append(weight / np.maximum(members, 1), 0.0)[group], 0.0)


def fit(rows: list[tuple[list[str], int]]) -> tuple[float, dict[str, float]]:
    """Bias and weights by feature from sample rows (features, label)."""
    sample = Sample(rows)
    if not (sample.label == 1).any() or not (sample.label == 0).any():
        return -60.0, {}
    votes = vote_table(sample)
    if not votes.size:
        return -60.0, {}
    bias, weight = train_linear(sample, label_model(votes, sample.label))
    return bias, {sample.names[i]: float(weight[i]) for i in np.flatnonzero(weight)}


def sample_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[list[str], int]]:
    """The bounded sample of labelled rows: the first in hash order of the ids. Only features that lean to
    the toxic rows of the sample are kept."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = named.where(~held_out()).orderBy(F.xxhash64("doc_id")).limit(LABELLED)
    wanted = F.broadcast(picked.withColumn("toxic", F.col("toxic").cast("int")))  # LABELLED rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.list_(pa.string()))], names=["doc_id", "toxic", "own"])

    one = docs.join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = one.select("doc_id", "toxic", "text").mapInArrow(extract, "doc_id long, toxic int, own array<string>")
    found = materialize(found, "toxic-sample")
    counts = found.select("toxic", F.explode("own").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    names = {r.f for r in counts.where((F.col("toxic") >= MIN_ROWS) & (F.col("toxic") >= MIN_SHARE * F.col("n"))).select("f").collect()}  # features of the sample

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[f for f in r if f in names] for r in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.list_(pa.string()))], names=["doc_id", "toxic", "own"])

    rows = found.mapInArrow(narrow, found.schema).collect()  # LABELLED rows at most
    return [(r.own, int(r.toxic == 1)) for r in sorted(rows, key=lambda r: r.doc_id)]


def with_score(docs: DataFrame, bias: float, weights: dict[str, float]) -> DataFrame:
    """docs with the column tox_score (a name that docs doesn't have)."""
    whole = {f: w for f, w in weights.items() if not f.endswith("*")}
    starts = {n: {f[:-1]: w for f, w in weights.items() if f.endswith("*") and len(f) == n + 1} for n in PREFIXES}
    starts = {n: s for n, s in starts.items() if s}

    def score(text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        total = bias + sum([whole[w] for w in words & whole.keys()])
        for n, known in starts.items():
            total += sum([known[p] for p in {w[:n] for w in words if len(w) > n} & known.keys()])
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                odds = np.array([score(t) for t in part.column("text").to_pylist()], np.float64)
                p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(p)], names=["doc", "tox_score"])

    rows = docs.select(F.struct(*quoted(docs.columns)).alias("doc"), "text")
    return rows.mapInArrow(run, rows.select("doc").withColumn("tox_score", F.lit(0.0)).schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bias, weights = fit(sample_rows(docs, labels))
    ids = with_score(docs, bias, weights).select("doc.doc_id", F.col("tox_score").alias("score"))
    return ids.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    bias, weights = fit(sample_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels))
    return with_score(docs, bias, weights).where(F.col("tox_score") < THRESHOLD).select("doc.*")
