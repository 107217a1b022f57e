"""Batches that are memorised against a plain pass over all looks, and runs that are repeated."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidepool.operators.memory import Memory

LOOK = "seq long, subject long, ref long, v array<float>, provenance string, sample string"


def looks(rnd, many, first):
    rows = []
    for k in range(many):
        v = [0.0] * 4 if rnd.random() < 0.05 else [rnd.gauss(0, 1) for _ in range(4)]
        rows.append((first + k, rnd.randrange(7), rnd.randrange(60), v, rnd.choice(["viewed-image:"] * 5 + ["clip-matched:", None]), f"s{rnd.randrange(9)}"))
    return rows


STATUS = {0: "confirmed", 1: "confirmed", 2: "draft", 3: "merged-into", 4: "confirmed", 5: "rejected"}


def plain(batches, proofs, out, cap):
    kept, audit = {}, {}
    for rows in batches:
        for seq, subject, ref, v, provenance, sample in sorted(rows):
            status = STATUS.get(subject)
            checks = [("provenance", provenance != "viewed-image:"), ("evidence", (sample, ref) not in proofs), ("subject", status is None), ("merged-into", status == "merged-into"), ("unconfirmed", status != "confirmed"), ("not-this", (subject, ref) in out), ("vector", np.linalg.norm(np.float32(v)) < 0.5)]
            gate = next((g for g, bad in checks if bad), None)
            own = kept.setdefault(subject, {}) if gate is None else None
            audit[seq] = ("refused", gate) if gate else ("already-held" if ref in own else "memorized", None)
            if audit[seq][0] == "memorized":
                w = np.float64(np.float32(v))
                own[ref] = w / np.linalg.norm(w)
                if len(own) > cap:
                    near = {r: max(round(float(own[r] @ own[q]), 9) for q in own if q != r) for r in own}
                    own.pop(min(own, key=lambda r: (-near[r], r)))
    return {(s, r) for s, own in kept.items() for r in own}, audit


@pytest.mark.parametrize("seed", [1, 2])
def test_two_batches_in_turn_and_again(spark, tmp_path, seed):
    rnd = random.Random(seed)
    first, second = looks(rnd, 150, 0), looks(rnd, 150, 1000)
    proofs = {(f"s{i}", r) for i in range(9) for r in range(60) if rnd.random() < 0.8}
    out = {(rnd.randrange(7), rnd.randrange(60)) for _ in range(15)}
    tables = (
        spark.createDataFrame(list(STATUS.items()), "subject long, status string"), spark.createDataFrame(sorted(proofs), "sample string, ref long"), spark.createDataFrame(sorted(out), "subject long, ref long"),
    )
    memory = Memory(spark, f"file://{tmp_path}/memory", cap=4)
    assert memory.exemplars().count() == 0 and memory.audit().count() == 0
    new = [memory.remember(run, spark.createDataFrame(rows, LOOK).repartition(3), *tables) for run, rows in (("one", first), ("two", second), ("one", first), ("two", second))]
    want, audit = plain([first, second], proofs, out, 4)
    assert new == [True, True, False, False] and memory.runs() == ["one", "two"]
    assert {(r.subject, r.ref) for r in memory.exemplars().collect()} == want
    assert {r.seq: (r.decision, r.gate) for r in memory.audit().collect()} == audit and memory.audit().count() == 300
    assert {g for _, g in audit.values()} >= {"provenance", "evidence", "subject", "merged-into", "unconfirmed", "not-this"}


def test_a_run_that_stopped_before_its_place_is_repeated(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/memory")
    tables = (spark.createDataFrame([(0, "confirmed")], "subject long, status string"), spark.createDataFrame([("s", 1), ("s", 2)], "sample string, ref long"), spark.createDataFrame([], "subject long, ref long"))
    spark.createDataFrame([(9, 9, 9, [1.0])], "subject long, ref long, seq long, v array<double>").write.parquet(f"{memory.folder}/exemplars/one")
    rows = spark.createDataFrame([(1, 0, 1, [1.0, 0.0], "viewed-image:", "s"), (2, 0, 2, None, "viewed-image:", "s")], LOOK)
    assert memory.exemplars().count() == 0 and memory.remember("one", rows, *tables)
    assert [r.ref for r in memory.exemplars().collect()] == [1] and memory.audit().where(F.col("gate") == "vector").count() == 1
