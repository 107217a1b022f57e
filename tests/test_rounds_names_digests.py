"""Question rounds, names inside texts and content digests against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidepool.operators import dictionary, digests
from tidepool.streaming import rounds

ROWS = "dump string, checkpoint long, tiles array<long>, reopened array<long>, final boolean"


def random_checkpoints(seed):
    rnd, out = random.Random(seed), []
    for dump in ("a", "b", "hot"):
        for k in range(rnd.randint(1, 30)):
            tiles = rnd.sample(range(25), rnd.randint(0, 8))
            out.append((dump, k, tiles, rnd.sample(range(25), rnd.randint(0, 4)), rnd.random() < 0.15))
    return out


def plain_gate(rows):
    state, out = {}, set()
    for dump, k, tiles, reopened, final in sorted(rows):
        s = state.setdefault(dump, {"fired": 0, "seen": set(), "ended": False})
        new = sum(t not in s["seen"] or t in reopened for t in tiles)
        last = final and not s["ended"]
        fire = last or (new >= rounds.FLOOR and s["fired"] < rounds.CAP)
        why = "final" if last else "cap" if new >= rounds.FLOOR and not fire else "floor"
        out.add((dump, k, fire, why, s["fired"] + 1, new, len(tiles)))
        s["fired"] += fire and not last
        s["ended"] |= last
        s["seen"] |= set(tiles) if fire else set()
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_as_a_fold(spark, seed):
    data = random_checkpoints(seed)
    got = rounds.gate(spark.createDataFrame(data, ROWS).repartition(4)).collect()
    assert {tuple(r) for r in got} == plain_gate(data) and len(got) == len(data)


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    """A stream that is stopped in the middle and taken up again decides as the fold over everything does, and a third
    run without new rows changes nothing."""
    data = random_checkpoints(7)
    first, second = [r for r in data if r[1] < 9], [r for r in data if r[1] >= 9]
    folder, out, schema = f"{tmp_path}/rows", f"{tmp_path}/out", spark.createDataFrame([], ROWS).schema
    spark.createDataFrame(first, ROWS).repartition(1).write.parquet(folder)
    assert {tuple(r) for r in rounds.run_gate(spark, folder, schema, out).collect()} == plain_gate(first)
    spark.createDataFrame(second, ROWS).repartition(1).write.mode("append").parquet(folder)
    for _ in range(2):
        found = rounds.run_gate(spark, folder, schema, out).collect()
        assert {tuple(r) for r in found} == plain_gate(data) and len(found) == len(data)


def test_names_are_found_wherever_they_begin(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    names = {word(rnd.randint(1, 7)) for _ in range(60)} | {"Customer#000000001", "Customer#000000002", "Customer#00000000"}
    texts = [(i, word(rnd.randint(0, 60))) for i in range(80)] + [(900, "x Customer#000000002 y"), (901, None), (902, ""), (903, "a" * 5000)]
    frame, known = spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(n,) for n in names] + [("a",), ("",), (None,)], "name string")
    got = Counter(tuple(r) for r in dictionary.found_in(frame, known).collect())
    names |= {"a"}
    want = Counter((i, n, k + 1) for i, t in texts for n in names for k in range(len(t or "")) if (t or "").startswith(n, k))
    assert got == want
    longest = dict(map(tuple, dictionary.longest_in(frame, known).collect()))
    held = {i: [(n, t.index(n)) for n in names if n in t] for i, t in texts if t}
    assert longest == {i: min(x, key=lambda m: (-len(m[0]), m[1], m[0]))[0] for i, x in held.items() if x}
    plan = dictionary.found_in(frame, known)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_names(spark):
    assert dictionary.found_in(spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "name string")).count() == 0


def test_digests_hold_under_any_partitioning(spark):
    rows = [(k % 4, k, None if k % 5 == 0 else f"t{k % 3}|1:", k / 7) for k in range(200)] + [(1, 5, "x", 0.5)] * 3
    schema = "part int, id int, text string, x double"
    frame = spark.createDataFrame(rows, schema)
    once = lambda f: {r.part: (r.rows, r.digest) for r in digests.part_digests(f, "part").collect()}
    base = once(frame)
    assert base == once(frame.repartition(7)) == once(frame.orderBy(F.desc("id")).coalesce(1)) == once(frame.select("x", "part", "text", "id"))
    whole = lambda f: digests.whole_digest(digests.part_digests(f, "part"), "part").first()
    assert whole(frame) == whole(frame.repartition(5)) and whole(frame).rows == len(rows)
    for changed in (rows[:-1], [*rows, rows[0]], [(p, i, t, x if i != 9 else 0.0) for p, i, t, x in rows], [(p, i, "" if t is None else t, x) for p, i, t, x in rows]):
        assert whole(spark.createDataFrame(changed, schema)) != whole(frame)


def test_what_broke_a_freeze_is_named(spark):
    schema = "part string, id int, text string"
    frozen = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, None), ("d", 4, "z")], schema)
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "Y"), ("c", 3, ""), ("e", 4, "z")], schema)
    of = lambda f: digests.part_digests(f, "part")
    assert {tuple(r) for r in digests.freeze_problems(of(frozen), of(now), "part").collect()} == {("b", "changed"), ("c", "changed"), ("d", "gone"), ("e", "new")}
    assert digests.freeze_problems(of(frozen), of(frozen.repartition(3)), "part").count() == 0
