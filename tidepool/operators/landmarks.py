"""Landmarks that photos vote for, the cascade that names a stop, and the places of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo
from tidepool.plans.stored import small, stored

c = F.col


def near_boxes(points: DataFrame, boxes: DataFrame, km: float, width: float = 0.01, step: int = 8) -> DataFrame:
    """points (lat, lon, ...) with each of boxes (south, west, north, east, ...; a node's sides are equal) within
    km, and their distance km (0 inside).

    A box lies on the grid whose cells are at least as wide as itself grown by km, so it touches four cells at most
    however large it is; a point has one row for each grid that occurs, of which there are as many as powers of
    `step` between the smallest and the largest box. Points meet boxes by an equi-join on cells.
    """
    up = km * 1.01 / geo.LAT_KM
    side = km * 1.01 / (geo.LON_KM * F.cos(F.radians(F.least(F.greatest(F.abs("south"), F.abs("north")), F.lit(85.0)))))
    span = F.greatest(c("north") - c("south") + 2 * up, c("east") - c("west") + 2 * side)
    grid = F.greatest(F.ceil(F.log(F.greatest(span, F.lit(width)) / width) / F.log(F.lit(float(step))) - 1e-9), F.lit(0)).cast("int")
    dealt = boxes.withColumn("grid", grid).withColumn("cell", width * F.pow(F.lit(float(step)), c("grid"))).withColumn("reach", side)
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / c("cell")), F.floor(high / c("cell"))))
    spread = dealt.withColumn("cy", cells(c("south") - up, c("north") + up)).withColumn("cx", cells(c("west") - c("reach"), c("east") + c("reach"))).drop("cell", "reach")
    grids = sorted(r.grid for r in dealt.select("grid").distinct().collect())  # a handful: powers of step
    if not grids:
        grids = [0]
    placed = points.withColumn("grid", F.explode(F.array(*map(F.lit, grids)))).withColumn("cell", width * F.pow(F.lit(float(step)), c("grid")))
    placed = placed.withColumn("cy", F.floor(c("lat") / c("cell"))).withColumn("cx", F.floor(c("lon") / c("cell"))).drop("cell")
    met = placed.join(spread, ["grid", "cy", "cx"]).drop("grid", "cy", "cx")
    return met.withColumn("km", F.round(geo.clamp_km(*map(c, ("lat", "lon", "south", "west", "north", "east"))), 9)).where(c("km") <= km)


def tier_of(rank: Column, km: Column) -> Column:
    """1 a sight the photo is at, 2 a sight in reach, 3 a stay it is at, 4 whatever is nearest."""
    at = km <= P.LANDMARK_AT_KM
    return F.when((rank == 0) & at, 1).when((rank == 0) & (km <= P.SIGHT_REACH_KM), 2).when(at, 3).otherwise(4)


def votes(points: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, rank, photos, km and photos by tier (t1 to t4), for points (keys, lat, lon, photos) and features
    (feature_no, name, rank, street, notable and their box).

    Each photo votes once, in the first tier that has a feature: within a tier for a sight or stay before a street,
    a notable one, one that holds the photo, the smallest, the nearest. Photos of one position vote alike, so
    they come counted and each position votes once, for all keys; of features that differ in name and number only the
    first by number counts.
    """
    node = (c("south") == c("north")) & (c("west") == c("east"))
    alike = ["rank", "street", "notable", "south", "west", "north", "east"]
    kinds = features.groupBy(*alike).agg(F.min_by("name", "feature_no").alias("name"), F.min("feature_no").alias("feature_no"))
    own = kinds.withColumn("node", node).withColumn("extent", F.round(geo.haversine_km(c("south"), c("west"), c("north"), c("east")), 9))
    met = near_boxes(points.select("lat", "lon").distinct(), own, P.LANDMARK_KM).withColumn("tier", tier_of(c("rank"), c("km")))
    holds = F.when(c("node"), c("km") <= P.NODE_AT_KM).otherwise(c("km") == 0)
    ranked, last = c("tier") < 4, F.lit(0.0)
    first = lambda x: F.when(ranked, x.cast("double")).otherwise(last)
    order = F.struct("tier", first(c("street")), first(~c("notable")), first(~holds), F.when(ranked, c("extent")).otherwise(c("km")), F.when(ranked, c("km")).otherwise(c("rank").cast("double")), "feature_no")
    chosen = met.groupBy("lat", "lon").agg(F.min_by(F.struct("name", "rank", "km", "tier"), order).alias("v"))
    vote = points.join(small(stored(chosen, "votes")), ["lat", "lon"])
    tiers = [F.sum(F.when(c("v.tier") == t, c("photos")).otherwise(0)).alias(f"t{t}") for t in (1, 2, 3, 4)]
    return vote.groupBy(*keys, c("v.name").alias("name")).agg(F.min("v.rank").alias("rank"), F.sum("photos").alias("photos"), F.min("v.km").alias("km"), *tiers)


def picks(found: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place (1 or 2) and name: the first landmark by rank, photos and distance, and a second of the same rank
    that has a third of all photos (totals: keys, total)."""
    w = Window.partitionBy(*keys).orderBy("rank", F.desc("photos"), "km", "name")
    ordered = found.withColumn("r", F.row_number().over(w)).withColumn("first", F.first("rank").over(w)).join(totals, keys)
    fit = ordered.where((c("r") == 1) | ((c("rank") == c("first")) & (c("photos") >= P.SECOND_SHARE * c("total") - 1e-9)))
    return fit.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("r"))).where(c("place") <= P.LANDMARKS).select(*keys, "place", "name")


def listed(rows: DataFrame, keys: list[str], order: str = "place") -> DataFrame:
    """keys and names: the few names of each key in order."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "name"))), lambda x: x["name"]).alias("names"))


def itinerary(days: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys and names: the distinct words of each key's days (day, words, mark) in travel order. No day is
    looked at once there are `most` names; landmarks (mark) give two names in all. Days of a key are few."""

    def put(held: Column, word: Column, mark: Column) -> Column:
        fits = ~F.array_contains(held["names"], word) & (~mark | (held["marks"] < P.LANDMARKS))
        added = F.struct(F.concat(held["names"], F.array(word)).alias("names"), (held["marks"] + mark.cast("int")).alias("marks"))
        return F.when(fits, added).otherwise(held)

    def step(held: Column, x: Column) -> Column:
        return F.when(F.size(held["names"]) >= most, held).otherwise(F.aggregate(x["words"], held, lambda h, w: put(h, w, x["mark"])))

    none = F.struct(F.array().cast("array<string>").alias("names"), F.lit(0).alias("marks"))
    rows = F.array_sort(F.collect_list(F.struct("day", "words", "mark")))
    return days.groupBy(*keys).agg(F.aggregate(rows, none, step)["names"].alias("names"))
