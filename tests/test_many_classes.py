"""Scores over more classes than fit in a plan."""

import numpy as np
import pytest
from tidepool.operators import recurrence, vectors
from tidepool.queries import QUERIES

LABELS = 103


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """(folder, vectors) of a table with two vectors of each label."""
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(2 * LABELS, 64)).astype("float32")
    folder = str(tmp_path_factory.mktemp("many"))
    rows = [(i, i % LABELS, x.tolist()) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    v = v.astype(float)
    return folder, v / np.linalg.norm(v, axis=1, keepdims=True)


def scores(unit):
    mean = (unit[:LABELS] + unit[LABELS:]) / 2
    return unit @ (mean / np.linalg.norm(mean, axis=1, keepdims=True)).T


def test_two_best_of_many_classes(spark, many, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    folder, unit = many
    s = scores(unit)
    got = {r.id: (r.best, r.score, r.margin) for r in QUERIES["zero_shot_top2"](spark, folder).collect()}
    assert len(got) == len(unit)
    for i, x in enumerate(s):
        a, b = np.argsort(-x)[:2]
        assert got[i][0] == str(a) and got[i][1:] == pytest.approx((x[a], x[a] - x[b]), abs=2e-6)
    paper = {r.id: r.score for r in QUERIES["paperwork_score"](spark, folder).collect()}
    assert [paper[i] for i in range(len(s))] == pytest.approx((s[:, :3].max(1) - s[:, 3:].max(1)).tolist(), abs=2e-6)
    for name in ("clip_verdict", "identity_verdict", "outlier_rank", "gray_picks", "ladder_picks", "question_pairs"):
        QUERIES[name](spark, folder).collect()


def test_equal_classes_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 2)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    centres = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [-1.0, 0.0]), ("e", [0.0, -1.0])], "name string, c array<double>")
    for most in (2, 100):
        got = sorted(tuple(r) for r in vectors.nearest_two(rows, centres, most).select("id", "best", "second").collect())
        assert got == [(1, "a", "b"), (1, "a", "b"), (2, "c", "a")]


def test_blast_radius_of_many_candidates(spark):
    angles = [k * 2 * np.pi / 1002 for k in range(1002)]
    rows = [(k, [float(np.cos(a)), float(np.sin(a))]) for k, a in enumerate(angles)]
    rows.append((2000, [float(np.cos(angles[7] + 1e-4)), float(np.sin(angles[7] + 1e-4))]))
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    clusters = frame.selectExpr("id", "id AS key")
    got = {r.key: (r["mass"], r["reach"]) for r in recurrence.blast_radius(frame, clusters, clusters.where("id < 2000").select("key"), 0.9, 0.05, 8).collect()}
    assert got == {k: (1, 2 if k == 7 else 1) for k in range(1002)}
