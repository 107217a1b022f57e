"""Clusters of look-alike files as recurring candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.operators import vectors
from tidepool.plans.stored import stored


def axes(members: DataFrame, key: str) -> DataFrame:
    """Evidence of each cluster of members (key, id, taken, area, has_camera). Of areas with
    equally many members the one of the smallest id counts."""
    dated = F.col("taken").isNotNull()
    base = members.groupBy(key).agg(
        F.count("*").alias("mass"),
        F.count_distinct(F.to_date("taken")).alias("days"),
        F.count_distinct(F.date_format("taken", "yyyy-MM")).alias("months"),
        F.round(F.count_if(F.hour("taken").isin(*P.NIGHT_HOURS)) / F.nullif(F.count_if(dated), F.lit(0)), 3).alias("night_share"),
        F.round(F.count_if(~F.col("has_camera")) / F.count("*"), 3).alias("no_camera_share"),
    )
    areas = members.where("area is not null").groupBy(key, "area").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    top = areas.groupBy(key).agg(F.max_by("area", F.struct(F.col("n"), -F.col("first"))).alias("bound_area"), F.max("n").alias("top"), F.sum("n").alias("placed"))
    out = base.join(top, key, "left")
    return out.withColumn("boundness", F.coalesce(F.round(F.col("top") / F.col("placed"), 3), F.lit(0.0))).drop("top", "placed")


def gate(found: DataFrame, mass: int = P.MASS, days: int = P.DAYS, months: int = P.MONTHS) -> DataFrame:
    return found.where((F.col("mass") >= mass) & (F.col("days") >= days) & (F.col("months") >= months))


def kind(found: DataFrame) -> DataFrame:
    bound = F.col("boundness") >= P.PLACE_BOUND
    out = (
        F.when(F.col("no_camera_share") >= P.NO_CAMERA_SHARE, "bulk_no_camera_class")
        .when(bound & F.col("bound_area").startswith("residence-"), "residence_bound_pattern")
        .when(bound & F.col("bound_area").isNotNull(), "place_bound_pattern")
        .otherwise("recurring_subject_or_scene")
    )
    return found.withColumn("kind", out)


def blast_radius(rows: DataFrame, clusters: DataFrame, candidates: DataFrame, tau: float, margin: float, mass: int) -> DataFrame:
    """(key, mass, reach): members plus leftovers. A leftover is in no candidate, its own
    cluster has fewer than `mass` members, and its nearest candidate is at least tau - margin alike.

    rows: id, v. clusters: id, key. candidates: key.
    """
    labelled = stored(rows.join(clusters, "id"), "clustered")
    sizes = clusters.groupBy("key").agg(F.count("*").alias("size"))
    centres = vectors.mean_vectors(labelled.join(candidates.select("key"), "key", "left_semi"), "key").select(F.col("key").cast("string").alias("name"), "c")
    counted = labelled.join(candidates.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("mass"))
    rest = labelled.join(candidates.select("key"), "key", "left_anti").join(sizes, "key").where(F.col("size") < mass).select("id", "v")
    near = vectors.nearest_two(rest, centres, 16).where(F.col("best_score") >= tau - margin)
    extra = near.groupBy(F.col("best").alias("k")).agg(F.count("*").alias("extra"))
    return counted.join(extra, F.col("key").cast("string") == F.col("k"), "left").select("key", "mass", (F.col("mass") + F.coalesce("extra", F.lit(0))).alias("reach"))
