"""Distances, boxes and grid cells as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions.parse import let
from tidepool.plans.stored import small


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * P.EARTH_KM * F.asin(F.sqrt(a))


def in_box(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def cell_floor(x: Column, width: float) -> Column:
    return F.floor(F.round(x / width, 6)).cast("long")


def cell_even(x: Column, width: float) -> Column:
    """Nearest cell, halves to even."""
    return F.bround(x / width, 0).cast("long")


def clamp_km(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Distance to the nearest point of a box."""
    return haversine_km(lat, lon, F.greatest(south, F.least(lat, north)), F.greatest(west, F.least(lon, east)))


def containment(a: list[Column], b: list[Column]) -> Column:
    """Shared area over the smaller area of boxes x0, y0, x1, y1."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(w * h / F.nullif(F.least(area(a), area(b)), F.lit(0.0)), F.lit(0.0))


def crossings(points: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Even-odd test: key, shape, inside for points (lat, lon) and edges (shape, y1, x1, y2, x2).

    Boxes prune before edges are looked at; both are broadcast only if they are small.
    """
    boxes = edges.groupBy("shape").agg(F.min("y1").alias("s"), F.max("y1").alias("n"), F.min("x1").alias("w"), F.max("x1").alias("e"))
    near = points.join(small(boxes), in_box(F.col("lat"), F.col("lon"), F.col("s"), F.col("w"), F.col("n"), F.col("e"))).drop("s", "n", "w", "e")
    # an edge is crossed by the ray to the east if the point lies between its ends in latitude and west of it
    between = (F.col("lat") < F.greatest("y1", "y2")) & (F.col("lat") >= F.least("y1", "y2"))
    at = F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    cross = between & (F.col("lon") < at)
    hit = F.count_if(F.when(F.col("y1") != F.col("y2"), cross).otherwise(F.lit(False)))
    return near.join(small(edges, 1_000_000), "shape").groupBy(*key, "shape").agg((hit % 2 == 1).alias("inside"))


def nearest_of(lat: Column, lon: Column, places: list[tuple[float, float, Column, dict]]) -> Column:
    """struct(km, fields...) of the nearest of a few places that are literals of the plan (lat, lon,
    whether it counts, fields): no join and no shuffle. NULL if none counts."""
    if not places:
        return F.lit(None).cast("struct<km:double>")
    text = lambda v: F.lit(v).cast("string")
    one = lambda p, y, x, own: F.struct(haversine_km(p["lat"], p["lon"], F.lit(y), F.lit(x)).alias("km"), *[text(v).alias(k) for k, v in own.items()])
    # the point and the conditions may be long expressions, so each is named once
    point = F.struct(lat.alias("lat"), lon.alias("lon"), *[counts.alias(f"c{i}") for i, (_, _, counts, _) in enumerate(places)])
    return let(point, lambda p: F.array_min(F.array(*[F.when(p[f"c{i}"] & p["lat"].isNotNull(), one(p, y, x, own)) for i, (y, x, _, own) in enumerate(places)])))


#: Kilometres a degree of latitude, and of longitude at the equator.
LAT_KM, LON_KM = 110.57, 111.32


def segment_km(lat: Column, lon: Column, y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """Distance from a point to a segment on the flat map around the point: the point is projected on
    the segment's line and held within its ends."""
    east = lambda x: (x - lon) * F.cos(F.radians(lat)) * LON_KM
    north = lambda y: (y - lat) * LAT_KM
    along_east, along_north = east(x2) - east(x1), north(y2) - north(y1)
    square = along_east * along_east + along_north * along_north
    share = -(east(x1) * along_east + north(y1) * along_north) / F.nullif(square, F.lit(0.0))
    held = F.coalesce(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.hypot(east(x1) + held * along_east, north(y1) + held * along_north)


def edge_km(points: DataFrame, edges: DataFrame, key: list[str], near_km: float | None = None) -> DataFrame:
    """key, shape, km: distance to the nearest edge of each shape; with near_km only edges in whose
    grown box the point lies are looked at, so shapes further away may be missing."""
    e = {n: F.col(n) for n in ("y1", "x1", "y2", "x2")}
    pairs = small(edges, 1_000_000)
    if near_km is None:
        met = points.join(pairs)
    else:
        dy = near_km / LAT_KM
        dx = near_km / (LON_KM * F.cos(F.radians("lat")))
        low, high = lambda a, b: F.least(e[a], e[b]), lambda a, b: F.greatest(e[a], e[b])
        met = points.join(pairs, in_box(F.col("lat"), F.col("lon"), low("y1", "y2") - dy, low("x1", "x2") - dx, high("y1", "y2") + dy, high("x1", "x2") + dx))
    km = segment_km(F.col("lat"), F.col("lon"), *e.values())
    return met.groupBy(*key, "shape").agg(F.min(km).alias("km"))


def country_of(points: DataFrame, edges: DataFrame, key: list[str], near_km: float) -> DataFrame:
    """key, shape: the shape that holds a point, else the nearest within near_km, else NULL. Of
    several that hold it the first by name counts."""
    held = crossings(points, edges, key).where("inside").groupBy(*key).agg(F.min("shape").alias("held"))
    outside = points.join(held, key, "left_anti")
    near = edge_km(outside, edges, key, near_km).where(F.col("km") <= near_km).groupBy(*key).agg(F.min_by("shape", F.struct("km", "shape")).alias("near"))
    return points.select(*key).join(held, key, "left").join(near, key, "left").select(*key, F.coalesce("held", "near").alias("shape"))


def near_pairs(points: DataFrame, features: DataFrame, km: float, width: float = 0.01) -> DataFrame:
    """points (lat, lon, ...) with each of features (flat, flon, ...) within km, and their distance km.

    A feature goes to every cell, `width` degrees wide, that its circle can touch, so the join is an
    equi-join on cells. Holds up to 85 degrees of latitude and off the date line. Bring points
    of one place together first: a hot place is then one row.
    """
    reach, shrink = km * 1.01, F.cos(F.radians(F.least(F.abs("flat"), F.lit(85.0))))
    up, side = F.ceil(F.lit(reach / (LAT_KM * width))), F.ceil(reach / (LON_KM * width * shrink))
    cy, cx = cell_floor(F.col("flat"), width), cell_floor(F.col("flon"), width)
    spread = features.withColumn("cy", F.explode(F.sequence(cy - up, cy + up))).withColumn("cx", F.explode(F.sequence(cx - side, cx + side)))
    met = points.withColumn("cy", cell_floor(F.col("lat"), width)).withColumn("cx", cell_floor(F.col("lon"), width)).join(spread, ["cy", "cx"]).drop("cy", "cx")
    return met.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("flat"), F.col("flon"))).where(F.col("km") <= km)
