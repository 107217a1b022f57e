"""Landmark votes, boxes near points and itineraries against plain Python."""

import math
import random
from collections import Counter

import pytest
import tidepool.queries as queries
from pyspark.sql import functions as F
from tidepool.operators import landmarks

FEATURE = "feature_no long, name string, rank int, street boolean, notable boolean, south double, west double, north double, east double"


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371.0 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


def away(lat, lon, f):
    return round(km(lat, lon, max(f["south"], min(lat, f["north"])), max(f["west"], min(lon, f["east"]))), 9)


def boxes(rnd, many):
    out = []
    for i in range(many):
        size = rnd.choice([0, 0, 0.0003, 0.001, 0.02, 0.3, 5.0])
        lat, lon = 60 + rnd.randint(0, 12) * 0.0005 - size * rnd.random(), 20 + rnd.randint(0, 12) * 0.0005 - size * rnd.random()
        out.append({"feature_no": i, "name": f"n{i % (many - 9)}", "rank": rnd.randint(0, 1), "street": rnd.random() < 0.3, "notable": rnd.random() < 0.4, "south": lat, "west": lon, "north": lat + size, "east": lon + size})
    return out


def vote(lat, lon, found):
    near = [(away(lat, lon, f), f) for f in found if away(lat, lon, f) <= 0.3]
    tiers = ([x for x in near if x[1]["rank"] == 0 and x[0] <= 0.05], [x for x in near if x[1]["rank"] == 0 and x[0] <= 0.15], [x for x in near if x[0] <= 0.05])
    for t, tier in enumerate(tiers, 1):
        if tier:
            node = lambda f: f["south"] == f["north"] and f["west"] == f["east"]
            holds = lambda d, f: d <= 0.025 if node(f) else d == 0
            extent = lambda f: round(km(f["south"], f["west"], f["north"], f["east"]), 9)
            return t, *min(tier, key=lambda x: (x[1]["street"], not x[1]["notable"], not holds(*x), extent(x[1]), x[0], x[1]["feature_no"]))
    return (4, *min(near, key=lambda x: (x[0], x[1]["rank"], x[1]["feature_no"]))) if near else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_photo_votes_once_by_tiers(spark, seed):
    rnd = random.Random(seed)
    found = boxes(rnd, 3 * seed + 12)
    points = {(60 + rnd.randint(-6, 18) * 0.0005, 20 + rnd.randint(-6, 18) * 0.0005): rnd.randint(1, 4) for _ in range(120)}
    photos, tiers, least = Counter(), Counter(), {}
    for (lat, lon), n in points.items():
        got = vote(lat, lon, found)
        if got:
            t, d, f = got
            photos[f["name"]] += n
            tiers[f["name"], t] += n
            rank, near = least.get(f["name"], (9, 9.0))
            least[f["name"]] = (min(rank, f["rank"]), min(near, d))
    rows = spark.createDataFrame([("k", a, b, n) for (a, b), n in points.items()], "key string, lat double, lon double, photos long")
    got = landmarks.votes(rows, spark.createDataFrame(found, FEATURE), ["key"]).collect()
    assert {r.name: (r.rank, r.photos, round(r.km, 6)) for r in got} == {n: (least[n][0], photos[n], round(least[n][1], 6)) for n in photos}
    assert all(r[f"t{t}"] == tiers[r.name, t] for r in got for t in (1, 2, 3, 4))


def test_boxes_of_all_sizes_meet_points_once(spark):
    rnd = random.Random(9)
    found = boxes(rnd, 60)
    points = [(i, 60 + rnd.uniform(-6, 6) / rnd.choice([1, 100, 1000]), 20 + rnd.uniform(-6, 6) / rnd.choice([1, 100, 1000])) for i in range(200)]
    rows = spark.createDataFrame(points, "id long, lat double, lon double")
    met = landmarks.near_boxes(rows, spark.createDataFrame(found, FEATURE), 2.0)
    got = Counter((r.id, r.feature_no) for r in met.select("id", "feature_no").collect())
    assert got == Counter((i, f["feature_no"]) for i, a, b in points for f in found if away(a, b, f) <= 2.0)
    plan = met._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_features_give_no_votes(spark):
    rows = spark.createDataFrame([("k", 1.0, 2.0, 3)], "key string, lat double, lon double, photos long")
    assert landmarks.votes(rows, spark.createDataFrame([], FEATURE), ["key"]).count() == 0


def plain_itinerary(days, most=4):
    names, marks = [], 0
    for words, mark in days:
        if len(names) >= most:
            break
        for w in words:
            if w not in names and not (mark and marks >= 2):
                names.append(w)
                marks += mark
    return names


def test_itineraries(spark):
    rnd = random.Random(4)
    trips = {t: [([rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 2))], rnd.random() < 0.5) for _ in range(rnd.randint(1, 9))] for t in range(80)}
    rows = [(t, k, words, mark) for t, days in trips.items() for k, (words, mark) in enumerate(days)]
    frame = spark.createDataFrame(rows, "trip long, day long, words array<string>, mark boolean").repartition(5)
    got = {r.trip: r.names for r in landmarks.itinerary(frame, ["trip"], 4).collect()}
    assert got == {t: plain_itinerary(days) for t, days in trips.items()} and max(map(len, got.values())) == 5


def test_every_tier_and_mode_occurs(spark, sf_dir):
    votes = queries.QUERIES["landmark_votes"](spark, sf_dir).agg(*[F.sum(f"t{t}") for t in (1, 2, 3, 4)]).first()
    assert all(n > 0 for n in votes)
    modes = {r[0] for r in queries.QUERIES["named_stops"](spark, sf_dir).select("mode").distinct().collect()}
    assert modes == {"home", "unnamed", "named", "landmark", "overpass", "area_z13", "overseas_z13"}
