"""Steps that depend on each other, over groups that are larger than a block."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidepool.functions import parse
from tidepool.operators import ladder, timeline, vectors
from tidepool.queries import QUERIES


@pytest.fixture
def blocks_of_seven(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)


def gathers(frame):
    """Whether a plan gathers a whole group in Python or in an array."""
    plan = frame._jdf.queryExecution().toString()
    return "FlatMapGroupsInPandas" in plan or "collect_list" in plan


@pytest.fixture(scope="module")
def groups():
    rnd = np.random.default_rng(5)
    out = {}
    for key, n in (("a", 40), ("b", 7), (None, 15), ("c", 1)):
        v = np.round(rnd.normal(size=(n, 3)), 1) + 0.01
        v[n // 2 :] = v[: n - n // 2]  # exact ties
        out[key] = v / np.linalg.norm(v, axis=1, keepdims=True)
    return out


@pytest.fixture(scope="module")
def frame(spark, groups):
    rows = [(k, 100 * j + i, v.tolist()) for j, (k, x) in enumerate(groups.items()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, id long, v array<double>").repartition(3)


def test_eviction_in_blocks(frame, groups, blocks_of_seven):
    got = vectors.evict(frame, "k", 3)
    assert not gathers(got)
    want = set()
    for j, (k, x) in enumerate(groups.items()):
        cos, left = np.round(x @ x.T, 9), list(range(len(x)))
        np.fill_diagonal(cos, -1.0)
        while len(left) > 3:
            left.pop(int(cos[np.ix_(left, left)].max(axis=1).argmax()))
        want |= {(k, 100 * j + i) for i in left}
    assert {tuple(r) for r in got.collect()} == want


def test_farthest_points_by_rounds(frame, groups):
    got = vectors.farthest_points(frame, "k", 5)
    assert not gathers(got)
    want = set()
    for j, (k, x) in enumerate(groups.items()):
        ids = sorted(range(len(x)), key=lambda i: hashlib.sha256(str(100 * j + i).encode()).hexdigest())
        mean, out = x.mean(axis=0), []
        like = np.round(x @ (mean / np.linalg.norm(mean)), 9)
        while len(out) < min(5, len(x)):
            at = min((i for i in ids if i not in out), key=lambda i: like[i])
            like = np.round(x @ x[at], 9) if not out else np.maximum(like, np.round(x @ x[at], 9))
            out.append(at)
        want |= {(k, 100 * j + i, r) for r, i in enumerate(out, 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_drafts_in_blocks(frame, groups, blocks_of_seven):
    got = ladder.fold_drafts(frame.withColumnRenamed("id", "seq"), "k", 0.9)
    assert not gathers(got)
    want = set()
    for j, (k, x) in enumerate(groups.items()):
        first = []
        for i, v in enumerate(x):
            cos = np.round(x[first] @ v, 9) if first else np.zeros(0)
            new = not (len(cos) and cos.max() >= 0.9)
            if new:
                first.append(i)
            want.add((k, 100 * j + i, 100 * j + (i if new else first[int(cos.argmax())]), "new" if new else "reinforced"))
    assert {tuple(r) for r in got.select("k", "seq", "draft", "state").collect()} == want


def test_ladder_by_row_numbers(spark):
    rnd = np.random.default_rng(8)
    rows = [(f"b{i % 3}", i, 4 * (i % 3), *(float(rnd.integers(9)) if rnd.random() < 0.3 else None for _ in range(3))) for i in range(60)]
    got = ladder.run_ladder(spark.createDataFrame(rows, "b string, id long, budget int, medoid_rank double, gray double, outlier double"), "b", 0.5)
    assert not gathers(got)
    want = set()
    for key in ("b0", "b1", "b2"):
        own = [r for r in rows if r[0] == key]
        budget, chosen = own[0][2], {}
        medoids = sorted((r for r in own if r[3] is not None), key=lambda r: (r[3], r[1]))
        steps = [(medoids, max(1, min(budget, round(budget * 0.5)))), (sorted((r for r in own if r[4] is not None), key=lambda r: (-r[4], r[1])), budget)]
        steps += [(sorted((r for r in own if r[5] is not None), key=lambda r: (r[5], r[1])), budget), (medoids, budget), (sorted(own, key=lambda r: hashlib.sha256(str(r[1]).encode()).hexdigest()), budget)]
        for rung, (order, most) in enumerate(steps, 1):
            for r in order:
                if most > 0 and len(chosen) < budget and r[1] not in chosen:
                    chosen[r[1]] = rung
                    most -= 1
        want |= {(key, i, rung) for i, rung in chosen.items()}
    assert {tuple(r) for r in got.collect()} == want


def test_bands_and_candidate_ids_gather_nothing(spark, sf_dir):
    assert not gathers(QUERIES["time_of_day"](spark, sf_dir)) and not gathers(QUERIES["candidate_ids"](spark, sf_dir))
    rows = spark.createDataFrame([("a", h) for h in (8, 9, 12, 12)] + [("b", 8), ("b", 16), (None, 3)], "k string, h int")
    assert {tuple(r) for r in timeline.upper_median_bands(rows, "k", F.col("h")).collect()} == {("a", "mostly midday"), ("b", "mostly late afternoon"), (None, "mostly after dark")}
    shas = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), (None, "z"), ("b", "x")], "k string, sha string")
    want = {(k, "rc-" + hashlib.sha256(x).hexdigest()[:12]) for k, x in (("a", b"x|y"), (None, b"z"), ("b", b"x"))}
    assert {tuple(r) for r in parse.candidate_ids(shas, "k").collect()} == want
