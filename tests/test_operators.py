"""Operators against hand-made rows and plain Python."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidepool.functions import geo, parse
from tidepool.operators import census, joins, rules, selection, timeline, vectors


def test_stamp_and_absent_markers(spark):
    rows = spark.createDataFrame([("2024:01:02 03:04:05.99+08:00",), ("-",), ("",), ("0000:00:00 00:00:00",), ("2024:02:30 00:00:00",), (None,)], "v string")
    got = [r[0] for r in rows.select(parse.stamp(F.col("v"))).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5)] + [None] * 5


def test_null_island_is_exact(spark):
    rows = spark.createDataFrame([("0, 0",), ("0 0.001",), ("25.1,121.2",), ("x 1",), ("1 2 3",)], "v string")
    got = [r[0] for r in rows.select(parse.gps(F.col("v"))).collect()]
    assert got[0] is None and tuple(got[1]) == (0.0, 0.001) and tuple(got[2]) == (25.1, 121.2) and got[3] is None and got[4] is None


def test_bounds_compare_by_their_own_length(spark):
    rows = spark.createDataFrame([("2024-05-09", "2024", None), ("2024-05-09", None, "2024-05"), ("2024-05-09", "2024-06", None), ("2024-05-09", "soon", "2023-13-99x")], "d string, a string, b string")
    got = [r[0] for r in rows.select(parse.within_bounds(F.col("d"), F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, False, True]


def test_tiers_need_no_camera_but_junk_does_not(spark):
    base = dict(file_type="JPEG", file_size="9", date_time_original="-", create_date="-", gps_position="-", make="-", model="-", width="1", height="2")
    rows = [
        base | {"file_name": "._x.jpg", "make": "Canon"},
        base | {"file_name": "Screenshot_1.jpg"},
        base | {"file_name": "Screenshot_1.mov", "file_type": "MOV"},
        base | {"file_name": "IMG-20240101-WA0001.jpg"},
        base | {"file_name": "a.jpg", "width": "1280"},
        base | {"file_name": "a.mov", "file_type": "MOV", "width": "1280"},
        base | {"file_name": "b.jpg"},
        base | {"file_name": "c.jpg", "make": "Canon"},
    ]
    frame = spark.createDataFrame(rows)
    got = {r.file_name: r.t and r.t["tier"] for r in frame.select("file_name", rules.tier().alias("t")).collect()}
    assert got == {"._x.jpg": "T0", "Screenshot_1.jpg": "T1", "Screenshot_1.mov": "T1", "IMG-20240101-WA0001.jpg": "T2", "a.jpg": "T3", "a.mov": "T4", "b.jpg": "T5", "c.jpg": None}


def test_nearest_offset_ties_and_window(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    rows = [("k", 1, t(10), 480), ("k", 2, t(12), 540), ("k", 3, t(12), 60), ("k", 9, t(11), None), ("k", 8, t(12, 5), None), ("k", 7, t(40), None)]
    frame = spark.createDataFrame(rows, "k string, id long, at timestamp_ntz, offset long")
    got = {r.id: r.d_offset for r in joins.nearest_offset(frame, ["k"], 24 * 3600).collect()}
    assert got == {9: 480, 8: 60}


@pytest.mark.parametrize("days,want", [(["a", None, "a"], "agree"), (["a", None, "b"], "disagree"), (["a", None, None], "no_anchor_one_side"), ([None], "no_anchor")])
def test_neighbour_days(spark, days, want):
    rows = spark.createDataFrame([("f", f"n{i}", i, d) for i, d in enumerate(days)], "folder string, name string, id long, day string")
    assert [r.verdict for r in joins.neighbour_days(rows).where("day is null").orderBy("id").collect()][0] == want


def test_fill_types_matches_a_walk(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for k in range(60):
        raw = [rnd.choice([None, None, "HOME", "AWAY", "ABROAD"]) for _ in range(rnd.randint(1, 7))]
        rows += [(k, i, x) for i, x in enumerate(raw)]
        now = list(raw)
        for i, x in enumerate(now):
            if x is None:
                p = next((y for y in reversed(now[:i]) if y), None)
                n = next((y for y in now[i + 1 :] if y), None)
                now[i] = p if p and p == n else "ABROAD" if "ABROAD" in (p, n) and None in (p, n) else "HOME"
        want |= {(k, i): x for i, x in enumerate(now)}
    got = timeline.fill_types(spark.createDataFrame(rows, "k long, day long, type string"), ["k"]).collect()
    assert {(r.k, r.day): r.type for r in got} == want


def test_stops_use_the_running_median(spark):
    at = lambda i: dt.datetime(2024, 1, 1, i)
    points = [("d", i, at(i), 25.0 + x / 111.2, 121.0) for i, x in enumerate([0, 2, 2.5, 4, 9, 9.5, 0])]
    got = timeline.stops(spark.createDataFrame(points, "day string, id long, at timestamp_ntz, lat double, lon double"), ["day"]).orderBy("id")
    assert [r.stop for r in got.collect()] == [1, 1, 1, 1, 2, 2, 3]


def test_split_runs_first_largest_jump(spark):
    days = [("r", i, 100, 25.0 + x, 121.0) for i, x in enumerate([0.0, 0.1, 0.5, 0.6, 1.0])]
    got = timeline.split_runs(spark.createDataFrame(days, "run string, day long, files long, lat double, lon double"), ["run"], 250)
    assert [r.part for r in got.orderBy("day").collect()] == [1, 1, 2, 2, 3]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_collision_suffix_fills_gaps(spark, seed):
    """The next free number beside names that already end as a renamed one, in any case."""
    rnd = random.Random(seed)
    stems = ["a", "A", "b", "a_dup2", "A_DUP2", "a_dup3", "a_dup2_dup2", "a_dup02", "a_dup1", "b_dup4", ".hid", "_dup2"]
    data = [(rnd.choice("xy"), rnd.choice(stems) + rnd.choice([".jpg", ".JPG", ".jpg", "", ".png"]), i) for i in range(rnd.choice([12, 60, 300]))]
    data += [("hot", "img.jpg", 1000 + i) for i in range(200)] + [("hot", f"img_dup{n}.jpg", 2000 + n) for n in (2, 3, 7, 50, 51, 300)] + [("hot", "IMG_dup9.jpg", 3000), ("hot", "IMG.jpg", 3001)]
    taken, want = set(), {}
    for dest, name, i in sorted(data, key=lambda r: (r[0], r[1].encode(), r[2])):
        stem, ext = joins.split_name(name)
        final, n = name, 2
        while (dest, final.lower()) in taken:
            final, n = f"{stem}_dup{n}{ext}", n + 1
        taken.add((dest, final.lower()))
        want[i] = final
    rows = spark.createDataFrame(data, "dest string, name string, id long").repartition(4)
    assert {r.id: r.final for r in joins.collision_suffix(rows).collect()} == want
    assert len({(r.dest, r.final.lower()) for r in joins.collision_suffix(rows).collect()}) == len(data)


def test_collision_suffix(spark):
    rows = spark.createDataFrame([("d", "A.jpg", 1), ("d", "a.JPG", 2), ("d", "b.jpg", 3), ("e", "a.jpg", 4), ("d", "noext", 5), ("d", "NOEXT", 6)], "dest string, name string, id long")
    assert {r.id: r.final for r in joins.collision_suffix(rows).collect()} == {1: "A.jpg", 2: "a_dup2.JPG", 3: "b.jpg", 4: "a.jpg", 6: "NOEXT", 5: "noext_dup2"}


def test_twins_prefer_the_tree_and_keep_the_shortest(spark):
    files = [("s/X 2.jpg", "X 2.jpg", 5, "h", False), ("s/X.jpg", "X.jpg", 5, "h", False), ("s/y.jpg", "y.jpg", 7, "t", False), ("s/c.jpg", "c.jpg", 7, "t", True), ("s/o.jpg", "o.jpg", 6, "h", False)]
    tree = [("tree/b.jpg", 7, "t"), ("tree/a.jpg", 7, "t")]
    got = joins.twins(spark.createDataFrame(files, "path string, name string, size long, sha string, copied boolean"), spark.createDataFrame(tree, "path string, size long, sha string"))
    assert {r.path: r.twin for r in got.collect()} == {"s/X 2.jpg": "s/X.jpg", "s/y.jpg": "tree/a.jpg"}


def test_aliases_follow_chains_and_refuse_loops(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 41)], "id long, target long")
    assert {r.id: r.root for r in joins.resolve_aliases(links).collect()} == {i: 41 for i in range(1, 41)}
    with pytest.raises(ValueError, match="loop"):
        joins.resolve_aliases(links.union(spark.createDataFrame([(77, 78), (78, 77)], links.schema)))


def test_touching_cells_are_eight_connected(spark):
    rnd = random.Random(5)
    cells = {(rnd.randint(0, 14), rnd.randint(0, 14)) for _ in range(70)} | {(50, x) for x in range(40)}
    want, todo = {}, set(cells)
    while todo:
        group, edge = set(), {min(todo)}
        while edge:
            group |= edge
            edge = {(y + a, x + b) for y, x in edge for a in (-1, 0, 1) for b in (-1, 0, 1)} & cells - group
        want |= {c: min(group) for c in group}
        todo -= group
    got = census.touching_cells(spark.createDataFrame(sorted(cells), "cy long, cx long")).collect()
    assert {(r.cy, r.cx): tuple(r.place) for r in got} == want


def test_even_spread_closed_form(spark):
    for n in (1, 5, 7, 8, 23):
        for k in (1, 3, 7):
            rows = spark.range(n).withColumn("g", F.lit(1))
            got = sorted(r.id for r in selection.even_spread(rows, ["g"], ["id"], k).collect())
            assert got == (list(range(n)) if n <= k else [int(i * n / k) for i in range(k)])


def blend(base, other, cos):
    return cos * base + np.sqrt(1 - cos**2) * other


def test_leaders_match_the_ordered_pass(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near, sha = x @ x.T >= 0.55, [hashlib.sha256(str(i).encode()).hexdigest() for i in range(60)]
    want = {}
    for i in sorted(range(60), key=lambda i: (-near[i].sum(), sha[i])):
        if i not in want:
            want |= {j: i for j in range(60) if near[i, j] and j not in want}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = vectors.leaders(rows, vectors.close_pairs(rows, 0.55)).collect()
    assert {r.id: r.leader for r in got} == want


def test_verdicts_at_the_real_bars(spark):
    base = np.eye(8)
    known = [("a", base[0].tolist()), ("b", blend(base[0], base[1], 0.99).tolist())]
    rows = spark.createDataFrame([(1, blend(base[0], base[2], 0.9).tolist()), (2, blend(base[0], base[2], 0.75).tolist()), (3, base[3].tolist())], "id long, v array<double>")
    got = vectors.top_two(rows, known).select("id", vectors.verdict(F.col("best_score"), F.col("second_score"), 0.82, 0.70, 0.03).alias("x"))
    assert {r.id: r.x for r in got.collect()} == {1: "question", 2: "gray", 3: "none"}


def test_boxes_are_dropped_by_kept_boxes_only(spark):
    boxes = [("f", 1, 0.9, 0, 0, 10, 10), ("f", 2, 0.8, 3, 0, 13, 10), ("f", 3, 0.7, 6, 0, 16, 10), ("g", 1, 0.9, 0, 0, 10, 10), ("g", 2, 0.8, 20, 0, 30, 10)]
    frame = spark.createDataFrame([(f, i, s, *map(float, b)) for f, i, s, *b in boxes], "file string, id long, score double, x0 double, y0 double, x1 double, y1 double")
    assert {(r.file, r.id) for r in vectors.suppress_boxes(frame, "file", 0.55).collect()} == {("f", 1), ("f", 3), ("g", 1), ("g", 2)}


def test_polygon_holes(spark):
    ring = [(0, 0, 0, 4), (0, 4, 4, 4), (4, 4, 4, 0), (4, 0, 0, 0), (1, 1, 1, 3), (1, 3, 3, 3), (3, 3, 3, 1), (3, 1, 1, 1)]
    edges = spark.createDataFrame([("s", *map(float, e)) for e in ring], "shape string, y1 double, x1 double, y2 double, x2 double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 9.0, 9.0)], "id long, lat double, lon double")
    assert {r.id: r.inside for r in geo.crossings(points, edges, ["id"]).collect()} == {1: True, 2: False}


def test_draft_vectors_never_move(spark):
    from tidepool.operators import ladder

    base = np.eye(4)
    seen = [base[0], blend(base[0], base[1], 0.9), blend(base[0], base[1], 0.6), base[2], blend(base[2], base[3], 0.86)]
    rows = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(seen)], "kind string, seq long, v array<double>")
    got = ladder.fold_drafts(rows, "kind", 0.85).orderBy("seq").collect()
    assert [(r.draft, r.state) for r in got] == [(0, "new"), (0, "reinforced"), (2, "new"), (3, "new"), (3, "reinforced")]


def test_ladder_keeps_room_for_later_rungs(spark):
    from tidepool.operators import ladder

    rows = [("b", i, 4, float(i + 1) if i < 4 else None, 0.8 if i == 5 else None, 0.1 if i == 6 else None) for i in range(8)]
    frame = spark.createDataFrame(rows, "batch string, id long, budget int, medoid_rank double, gray double, outlier double")
    got = {r.id: r.rung for r in ladder.run_ladder(frame, "batch", 0.5).collect()}
    assert got == {0: 1, 1: 1, 5: 2, 6: 3}


def test_name_units_and_problems(spark):
    from tidepool.functions import names

    rows = spark.createDataFrame([("東京_lake view",), ("20240101_a",), ("2024_a?",), ("20240101__x",)], "n string")
    got = rows.select(names.name_units(F.col("n")).alias("u"), names.name_problems(F.col("n"), 3).alias("p")).collect()
    assert [(r.u, r.p) for r in got] == [(4, "bad_period,too_long"), (2, ""), (2, "bad_period,illegal_character"), (2, "empty_slot")]


def test_eviction_drops_the_most_redundant(spark):
    base = np.eye(4)
    rows = [("k", 1, base[0]), ("k", 2, blend(base[0], base[1], 0.99)), ("k", 3, base[2]), ("k", 4, blend(base[2], base[3], 0.9))]
    frame = spark.createDataFrame([(k, i, v.tolist()) for k, i, v in rows], "k string, id long, v array<double>")
    assert {r.id for r in vectors.evict(frame, "k", 2).collect()} == {2, 4}


def test_staleness(spark):
    rows = spark.createDataFrame([("a/x", "x", 5), ("a/y", "y", 5), ("a/z", "z", 5), ("a/w", "w", 0), ("a/v", "v", 7)], "path string, name string, size long")
    there = spark.createDataFrame([("a/x", "x", 5), ("b/y", "y", 5), ("c/y", "y", 6), ("b/w", "w", 1), ("c/w", "w", 2), ("b/v", "v", 9)], "path string, name string, size long")
    got = {r.path: (r.verdict, r.candidate) for r in joins.staleness(rows, there).collect()}
    assert got == {"a/x": ("present", None), "a/y": ("moved", "b/y"), "a/z": ("gone", None), "a/w": ("ambiguous", "b/w"), "a/v": ("moved", "b/v")}


def test_media_tree_reads_only_what_the_cache_lacks(spark, tmp_path):
    from tidepool.sources import media

    for name, data in (("a.jpg", b"\xff\xd8\xff1"), ("b.png", b"x"), ("._c.jpg", b"y"), ("d.txt", b"z")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "e.jpg").write_bytes(b"q")
    files = media.media_files(spark, str(tmp_path))
    assert sorted(r.name for r in files.collect()) == ["a.jpg", "b.png"]
    cache = files.where("name = 'a.jpg'").select("path", "size", "modified", F.lit("cached").alias("sha"))
    got = {r.name: r.sha for r in media.hashed_tree(spark, str(tmp_path), cache).collect()}
    assert got == {"a.jpg": "cached", "b.png": hashlib.sha256(b"x").hexdigest()}


def test_recursion_free_roots(spark):
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d",), ("/c/d/e/f",)], "root string")
    assert {r.root for r in joins.outermost(roots).collect()} == {"/a", "/ab", "/c/d"}


def test_greedy_matching(spark):
    rnd = random.Random(8)
    pairs = sorted({(rnd.randint(0, 9), rnd.randint(20, 29)) for _ in range(45)})
    rows = [(a, b, round(rnd.choice([0.9, 0.95, rnd.random()]), 3)) for a, b in pairs]
    want, new, old = set(), set(), set()
    for a, b, cos in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in new and b not in old:
            want.add((a, b))
            new.add(a)
            old.add(b)
    got = vectors.match_best_first(spark.createDataFrame(rows, "new long, old long, cos double")).collect()
    assert {(r.new, r.old) for r in got} == want


def test_areas_match_the_ordered_pass(spark):
    rnd = random.Random(6)
    rows = []
    for _ in range(400):
        y, x = rnd.choice([(25.0, 121.0), (25.03, 121.02), (25.3, 121.3)])
        rows.append((y + rnd.randint(-4, 4) * 0.01, x + rnd.randint(-4, 4) * 0.01, rnd.randint(1, 28), rnd.randint(1, 4), rnd.random() < 0.3))
    cells = {}
    for r in rows:
        cells.setdefault((round(r[0] / 0.01), round(r[1] / 0.01)), []).append(r)
    place = lambda k: (k[0] * 0.01, k[1] * 0.01)
    found, used = [], set()
    for seed in sorted(cells, key=lambda k: (-len(cells[k]), k)):
        if seed not in used:
            own = [k for k in cells if k not in used and timeline.km(*place(seed), *place(k)) <= 2.0]
            used |= set(own)
            found.append([seed, [r for k in own for r in cells[k]]])
    stat = lambda m: (len(m), len({r[2] for r in m}), len({r[3] for r in m}), round(sum(r[4] for r in m) / len(m), 6))
    home = lambda m: stat(m)[1] >= 8 and stat(m)[2] >= 3 and stat(m)[3] >= 0.25
    homes = [a for a in found if home(list(a[1]))]
    flags = {a[0]: home(a[1]) for a in found}
    want = {}
    for seed, own in found:
        to = seed if flags[seed] else next((h[0] for h in homes if timeline.km(*place(h[0]), *place(seed)) <= 5.0), seed)
        want.setdefault(to, []).extend(own)
    frame = spark.createDataFrame(rows, "lat double, lon double, day long, month long, night boolean")
    got = {r.seed: (r.files, r.days, r.months, r.night_share, r.residence) for r in census.areas(frame).collect()}
    assert got == {f"{k[0]}:{k[1]}": (*stat(m), flags[k]) for k, m in want.items()}


def test_near_pairs_match_all_pairs(spark):
    import math
    import random

    rnd = random.Random(2)
    at = lambda lat, lon: (lat + rnd.uniform(-0.03, 0.03), lon + rnd.uniform(-0.03, 0.03))
    centres = [(25.0, 121.5), (-33.9, 18.4), (69.6, 18.9), (0.0, 0.0)]
    points = [(i, *at(*centres[i % 4])) for i in range(240)]
    features = [(i, *at(*centres[i % 4])) for i in range(160)]

    def km(a, b, x, y):
        h = math.sin(math.radians(x - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(x)) * math.sin(math.radians(y - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    got = geo.near_pairs(spark.createDataFrame(points, "p long, lat double, lon double"), spark.createDataFrame(features, "f long, flat double, flon double"), 0.7)
    want = {(p, f) for p, a, b in points for f, x, y in features if km(a, b, x, y) <= 0.7}
    assert len(want) > 100 and sorted((r.p, r.f) for r in got.collect()) == sorted(want)


def test_guards_raise(spark):
    from tidepool.operators import rules
    from tidepool.sources import media

    files = spark.createDataFrame([("f", "a"), ("f", "a"), ("f", "b")], "folder string, file_name string")
    assert media.whole_scan(files, files).count() == 3
    with pytest.raises(ValueError, match="missed 1 files"):
        media.whole_scan(files, files.dropDuplicates())
    rules.refuse(files.limit(0), "names")
    with pytest.raises(ValueError, match="names: 3 problems"):
        rules.refuse(files, "names")
