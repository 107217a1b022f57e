"""Deterministic sampling, budgets and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget(n: Column, rate: float, least: int, most: int) -> Column:
    """round-half-even(n * rate) between least and most, and at most n."""
    return F.least(n, F.greatest(F.lit(least), F.least(F.lit(most), F.bround(n * F.lit(rate), 0).cast("long"))))


def quota(n: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.least(n, F.bround(n * F.lit(share), 0).cast("long")))


def picked(position: Column, n: Column, k: Column) -> Column:
    """Whether position (from 0) is one of the k places floor(i * n / k)."""
    i = F.ceil(position * k / n)
    return (i < k) & (F.floor(i * n / k) == position)


def even_spread(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("cnt", F.count("*").over(w))
    return placed.where(F.when(F.col("cnt") <= k, F.lit(True)).otherwise(picked(F.col("pos"), F.col("cnt"), F.lit(k)))).drop("pos", "cnt")


def stratified(rows: DataFrame, keys: list[str], day: str, order: list[str], total: int) -> DataFrame:
    """Each day gets its share of the budget, at least one, spread within the day."""
    pool = rows.groupBy(*keys).agg(F.count("*").alias("pool"))
    w = Window.partitionBy(*keys, day)
    placed = rows.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("cnt", F.count("*").over(w)).join(pool, keys)
    k = F.greatest(F.lit(1), F.bround(F.lit(total) * F.col("cnt") / F.col("pool"), 0).cast("long"))
    return placed.where((k >= F.col("cnt")) | picked(F.col("pos"), F.col("cnt"), k)).drop("pos", "cnt", "pool")
