"""Steps whose work must grow no faster than their input."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidepool.operators import joins, timeline

DAY = date(2024, 1, 1)


def plan(frame):
    return frame._jdf.queryExecution().toString().lower()


def neighbours(spark):
    return joins.neighbour_days(spark.createDataFrame([("f", f"n{i % 3}", i, None if i % 2 else DAY + timedelta(i // 4)) for i in range(12)], "folder string, name string, id long, day date"))


def offsets(spark):
    at = lambda n: datetime(2024, 1, 1) + timedelta(seconds=n)
    return joins.nearest_offset(spark.createDataFrame([("k", i, at(i * 7 % 30), None if i % 3 else i) for i in range(30)], "key string, id long, at timestamp, offset int"), ["key"], 20)


def types(spark):
    return timeline.fill_types(spark.createDataFrame([("k", DAY + timedelta(i), "HOME" if i % 5 == 0 else None) for i in range(12)], "key string, day date, type string"), ["key"])


@pytest.mark.parametrize("step", [neighbours, offsets, types])
def test_no_frame_is_read_anew_for_each_row(spark, step):
    found = step(spark)
    assert found.count() > 0 and "unboundedfollowing" not in plan(found)


def test_folders_of_the_same_days_meet_trips_once(spark, sf_dir, monkeypatch):
    from tidepool.queries import trips

    seen, real = [], trips.spans.overlapping

    def watched(left, right, keys):
        seen.append((left, right))
        return real(left, right, keys)

    monkeypatch.setattr(trips.spans, "overlapping", watched)
    assert trips.into_existing_trips(spark, sf_dir).count() > 0
    (left, right), = seen
    assert left.count() == left.select("archive", "a", "z").distinct().count()
    assert right.count() == right.select("archive", "first", "last").distinct().count()


def test_a_walk_looks_at_a_used_span_once():
    from tidepool.operators import spans

    many = 2000
    beside, used = {2: [(f"f{i:04}", 2) for i in range(many)][::-1]}, set()
    found = [spans.walk(beside, used, 1, 1) for _ in range(many + 5)]
    assert found == [[f"f{i:04}"] for i in range(many)] + [[]] * 5 and beside == {2: []}


def test_votes_and_shapes_meet_positions_once(spark, sf_dir, monkeypatch):
    from tidepool.functions import geo
    from tidepool.operators import landmarks
    from tidepool.queries import QUERIES

    seen = []
    for module, name in ((landmarks, "near_boxes"), (geo, "near_pairs")):
        def watched(points, other, *rest, real=getattr(module, name)):
            seen.append((points, other))
            return real(points, other, *rest)

        monkeypatch.setattr(module, name, watched)
    assert QUERIES["named_stops"](spark, sf_dir).count() > 0 and len(seen) == 2
    for points, other in seen:
        assert points.count() == points.select("lat", "lon").distinct().count()
        assert other.count() == other.drop("name", "feature_no").distinct().count()


def test_running_medians_insert_by_bisection(monkeypatch):
    middle = timeline.Middle()
    monkeypatch.setattr(timeline.np, "searchsorted", None)  # it reads the whole list for each value
    for x in (3.0, 1.0, 2.0, 10.0):
        middle.add(x)
    assert middle.get() == 2.5


def test_a_log_is_replayed_in_batches(spark, sf_dir):
    from tidepool.operators import lifecycle
    from tidepool.queries import lives

    log = lives.log(spark, sf_dir)
    found = lifecycle.replay(log, "pack", lives.CAP)
    assert "flatmapgroupsinpandas" not in plan(found)
    whole = sorted(map(str, found.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, lifecycle.replay(log, "pack", lives.CAP).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["cap_eviction", "draft_store"])
def test_rounds_of_blocks_stay_one_scan(spark, sf_dir, monkeypatch, name):
    from tidepool.operators import vectors
    from tidepool.queries import QUERIES

    want = sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 7)
    found = QUERIES[name](spark, sf_dir)
    assert plan(found).split("== physical plan ==")[1].count("filescan parquet") == 1
    assert sorted(map(tuple, found.collect())) == want


@pytest.mark.parametrize("few", [0, 32])
def test_leaders_of_dense_rows_store_no_pairs(spark, monkeypatch, few):
    import numpy as np
    from tidepool.operators import vectors

    x = np.random.default_rng(3).normal(size=(300, 6))
    x[200:220] = x[:20]
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    want = set(map(tuple, vectors.leaders(rows, vectors.close_pairs(rows, 0.55)).collect()))
    for name, value in (("BLOCK", 7), ("TILE", 5), ("FEW", few)):
        monkeypatch.setattr(vectors, name, value)
    seen, real = [], vectors.close_pairs
    monkeypatch.setattr(vectors, "close_pairs", lambda rows, tau: seen.append(tau) or real(rows, tau))
    assert set(map(tuple, vectors.alike_leaders(rows, 0.55).collect())) == want
    assert len(seen) == (few > 0)


def test_many_candidates_are_no_literals(spark):
    import numpy as np
    from tidepool.operators import recurrence

    eye = np.eye(40)
    rows = [(100 * k + i, (eye[k] if i < 3 else 0.8 * eye[k] + 0.6 * eye[(k + 1) % 40]).tolist(), k if i < 3 else 1000 + k) for k in range(40) for i in range(4)]
    frame = spark.createDataFrame(rows, "id long, v array<double>, key long").repartition(3)
    found = recurrence.blast_radius(frame.select("id", "v"), frame.select("id", "key"), frame.where("key < 40").select("key").distinct(), 0.8, 0.05, 8)
    assert {tuple(r) for r in found.collect()} == {(k, 3, 4) for k in range(40)}
    assert len(plan(found)) < 400_000


def test_a_block_travels_to_a_fixed_number_of_others(spark, monkeypatch):
    from tidepool.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 1)
    for n in (1, 2, 60, 133, 400):
        rows = spark.range(n).withColumn("v", F.array(F.lit(1.0)))
        pairs = vectors.pairs_of_blocks(*vectors.packed_blocks(rows)).select(F.explode("x.id").alias("a"), "y").select("a", F.explode("y.id").alias("b"))
        met = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        blocks = vectors.block_count(n)
        assert blocks <= 48 and met.count() == n * (n + 1) // 2
        assert vectors.pairs_of_blocks(*vectors.packed_blocks(rows)).count() <= blocks * (blocks + 1) // 2


def test_long_names_meet_only_lines_that_may_hold_them(spark):
    from tidepool.operators import dictionary

    names = spark.range(2000).selectExpr("concat('Customer#', lpad(cast(id as string), 9, '0')) as name")
    sizes = dictionary.grams(names).groupBy("gram").agg(F.count("*").alias("n"))
    lines = spark.range(500).selectExpr("id", "concat('reach: IMG_', lpad(cast(id as string), 4, '0'), case when id % 50 = 0 then concat(' in Customer#', lpad(cast(id as string), 9, '0'), '/x') else '' end) as text")
    assert sizes.groupBy().agg(F.min("n")).first()[0] == 1
    found = dictionary.found_in(lines, names)
    assert {(r.id, r.name) for r in found.collect()} == {(i, f"Customer#{i:09}") for i in range(0, 500, 50)}
    rare = dictionary.grams(names).join(sizes, "gram").groupBy("name").agg(F.min("n").alias("n"))
    assert rare.agg(F.max("n")).first()[0] <= 10


def test_files_of_places_are_read_once_and_summed(spark, sf_dir, monkeypatch):
    from tidepool.operators import census
    from tidepool.queries import QUERIES

    seen, real = [], census.stored
    monkeypatch.setattr(census, "stored", lambda df, tag: seen.append(tag) or real(df, tag))
    found = QUERIES["place_components"](spark, sf_dir)
    assert found.count() > 0 and "cell-days" in seen
    assert "events.parquet" not in " ".join(found.inputFiles())


def test_boxes_are_suppressed_without_python(spark):
    import random

    from tidepool.operators import vectors

    rnd, rows = random.Random(4), []
    for file in range(30):
        for i in range(rnd.randint(1, 12)):
            x, y, w, h = rnd.randint(0, 9), rnd.randint(0, 9), rnd.randint(0, 9), rnd.randint(0, 9)
            rows.append((file, i, rnd.choice([0.1, 0.5, 0.9]), *map(float, (x, y, x + w, y + h))))
    want, kept = set(), {}
    for file, i, _, x0, y0, x1, y1 in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        for a0, b0, a1, b1 in kept.setdefault(file, []):
            small = min((x1 - x0) * (y1 - y0), (a1 - a0) * (b1 - b0))
            if small > 0 and max(min(x1, a1) - max(x0, a0), 0) * max(min(y1, b1) - max(y0, b0), 0) / small > 0.55:
                break
        else:
            kept[file].append((x0, y0, x1, y1))
            want.add((file, i))
    got = vectors.suppress_boxes(spark.createDataFrame(rows, "file long, id long, score double, x0 double, y0 double, x1 double, y1 double"), "file", 0.55)
    assert {tuple(r) for r in got.collect()} == want and "python" not in plan(got) and "inarrow" not in plan(got)


def test_checkpoints_that_arrive_together_may_lie_in_many_files(spark, tmp_path):
    from tidepool.streaming import rounds

    rows = "dump string, checkpoint long, tiles array<long>, reopened array<long>, final boolean"
    data = [(f"d{i % 3}", k, [k, k + 1, 20 + i % 7], [k] if i % 2 else [], k == 7) for i, k in enumerate([5, 1, 7, 2, 8, 3, 6, 4] * 3)]
    data = list({(d, k): (d, k, *rest) for d, k, *rest in data}.values())
    frame = spark.createDataFrame(data, rows)
    frame.repartition(6, "checkpoint").write.parquet(f"{tmp_path}/rows")
    found = rounds.run_gate(spark, f"{tmp_path}/rows", frame.schema, f"{tmp_path}/out")
    want = sorted(map(tuple, rounds.gate(frame).collect()))
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, rounds.streamed(frame.repartition(5)).collect())) == want


def test_blocks_of_a_key_reach_python_as_arrow(spark):
    from tidepool.operators import vectors

    rows = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.6, 0.8]), ("b", 3, [1.0, 0.0])], "k string, id long, v array<double>")
    found = vectors.coherence(rows, "k")
    assert {tuple(r) for r in found.collect()} == {("a", 0.6)} and "inpandas" not in plan(found)


def test_rows_are_matched_from_lists_not_pairs(spark, sf_dir, monkeypatch):
    import numpy as np
    from tidepool.operators import vectors
    from tidepool.queries import more

    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(240, 8))
    v[rnd.choice(240, 60, replace=False)] = v[7]
    v[:40] = v[40] + 0.3 * v[:40]
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = rnd.permutation(1000)[:240]
    cos, want, new, old = v @ v.T, [], set(), set()
    pairs = [(-round(float(cos[i, j]), 9), int(ids[i]), int(ids[j])) for i in range(240) for j in range(240) if ids[i] < ids[j] and cos[i, j] >= 0.2]
    for c, a, b in sorted(pairs):
        if a not in new and b not in old:
            want.append((a, b, -c))
            new.add(a)
            old.add(b)
    rows, real = [], vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda df, tag: (lambda out: rows.append(out.count()) or out)(real(df, tag)))
    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "ASKERS", 90)
    monkeypatch.setattr(vectors, "OFFERS", 2)
    monkeypatch.setattr(vectors, "TILE", 32)
    monkeypatch.setattr(vectors, "FIRST", 8)
    frame = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>")
    monkeypatch.setattr(more, "unit", lambda s, d: frame)
    found = more.QUERIES["prior_match"](spark, sf_dir)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and found.columns == ["new", "old", "cos"]
    assert len(pairs) > 6000 and max(rows) <= 8 * 240


def test_copies_are_matched_in_few_rounds(spark, monkeypatch):
    from tidepool.operators import vectors

    rounds, real = [], vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda df, tag: rounds.append(tag) or real(df, tag))
    pairs = spark.createDataFrame([(a, b, 1.0) for a in range(12) for b in range(a + 1, 12)], "new long, old long, cos double")
    assert {(r.new, r.old) for r in vectors.match_best_first(pairs).collect()} == {(a, a + 1) for a in range(11)}
    assert len(rounds) <= 8
