"""Estimates per language and source against minimum-covariance-determinant estimates from many random starts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidepool.llm import quality_mcd


def best_of_many_starts(y, rng):
    """Mean and scatter with the smallest determinant found by concentration from 200 random subsets."""
    n, ridge = len(y), np.diag([f**2 * (1 + quality_mcd.RIDGE_ROWS / (0.75 * len(y))) for f in quality_mcd.FLOORS])
    h, best = int(np.ceil(0.75 * n)), None
    for _ in range(200):
        rows = rng.choice(n, 6, replace=False)
        for _ in range(15):
            m, s = y[rows].mean(axis=0), np.cov(y[rows].T, bias=True) * quality_mcd.CONSISTENCY + ridge
            d = np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(s), y - m)
            rows = np.argsort(d, kind="stable")[:h]
        if best is None or np.linalg.det(s) < best[0]:
            best = (np.linalg.det(s), d)
    return best[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_outliers_of_small_and_large_groups(spark, seed):
    rnd, rng, docs, planted = random.Random(seed), np.random.default_rng(seed), [], set()
    sizes = {("en", "a"): 14, ("en", "b"): 40, ("de", "a"): 150, ("de", "b"): 25, ("fr", "x"): 4, ("fr", "y"): 3}
    for (lang, source), n in sizes.items():
        for k in range(n):
            mean = {"en": 4, "de": 8, "fr": 5}[lang]
            words = ["".join(rnd.choice("abcdefghij") for _ in range(max(1, round(rnd.gauss(mean, 2))))) for _ in range(rnd.randint(80, 160))]
            if k % 7 == 3:
                words = [w + rnd.choice(["##", "$$%", "<|>"]) for w in words]
                planted.add(len(docs))
            docs.append((len(docs), " ".join(words), lang, source))
    rows = quality_mcd.verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).withColumns({f"y{i + 1}": y for i, y in enumerate(quality_mcd.vector())}).orderBy("doc_id").toPandas()
    y = rows[["y1", "y2", "y3", "y4"]].to_numpy(float)
    for key, n in sizes.items():
        if n < quality_mcd.MIN_GROUP:
            continue
        own = np.array([i for i, d in enumerate(docs) if d[2:] == key])
        want = best_of_many_starts(y[own], rng) <= quality_mcd.CUTOFF
        assert rows["kept"].to_numpy(bool)[own].tolist() == want.tolist() == [i not in planted for i in own]


def test_groups_of_few_rows_share_their_languages_estimate(spark):
    counts = spark.createDataFrame([("en", "a", 11), ("en", "b", 10), ("en", "c", 9), ("de", "a", 2), ("fr", "z", 3)], "lang string, source string, n long")
    got = {(r.lang, r.source): (r.g_lang, r.g_source) for r in quality_mcd.group_keys(counts).select("lang", "source", "g_lang", "g_source").collect()}
    assert got == {("en", "a"): ("en", "a"), ("en", "b"): ("en", "*"), ("en", "c"): ("en", "*"), ("de", "a"): ("*", "*"), ("fr", "z"): ("*", "*")}


def test_fewer_rows_have_a_wider_floor(spark):
    rows = spark.range(40).select(F.when(F.col("id") < 4, "few").otherwise("many").alias("g"), *[F.lit(1.0).alias(n) for n in quality_mcd.STATS])
    got = {r.g: r.l11 for r in quality_mcd.estimates(rows, ["g"], 1.0).collect()}
    floor = quality_mcd.FLOORS[1]
    assert np.isclose(got["few"], floor * np.sqrt(1 + quality_mcd.RIDGE_ROWS / 4)) and np.isclose(got["many"], floor * np.sqrt(1 + quality_mcd.RIDGE_ROWS / 36))
