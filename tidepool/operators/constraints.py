"""A catalogue of constraints that are evaluated together, in one pass over the rows they are about."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEM, WARNING = "problem", "warning"


@dataclass(frozen=True)
class Rule:
    """A rule that rows break where `broken` is true. A detail says by what."""

    name: str
    severity: str
    broken: Column
    detail: Column | None = None


def broken(rows: DataFrame, key: Column, rules: list[Rule]) -> DataFrame:
    """key, rule, severity and detail of every rule that a row breaks, whatever else it breaks. A condition
    that is null breaks nothing."""
    kind = "struct<rule:string,severity:string,detail:string>"
    each = [
        F.when(r.broken, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), (F.lit("") if r.detail is None else F.coalesce(r.detail.cast("string"), F.lit(""))).alias("detail"))).cast(kind)
        for r in rules
    ]
    return rows.select(key.cast("string").alias("key"), F.inline(F.array_compact(F.array(*each))))


def verdict(found: DataFrame, keys: DataFrame) -> DataFrame:
    """key, problems and warnings of every key, and whether it passes: it has no problem."""
    counted = found.groupBy("key").agg(F.count_if(F.col("severity") == PROBLEM).alias("problems"), F.count_if(F.col("severity") == WARNING).alias("warnings"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    return keys.select(F.col("key").cast("string").alias("key")).join(counted, "key", "left").select("key", zero("problems"), zero("warnings")).withColumn("passes", F.col("problems") == 0)
