"""Folder names and map tags."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render(period: Column, country: Column, where: Column, who: Column, what: Column) -> Column:
    """Slots joined by underscores; places and people are joined by plus signs."""
    slot = lambda c: F.when(F.size(c) > 0, F.array_join(c, "+"))
    return F.concat_ws("_", period, country, slot(where), slot(who), what)


def slot(name: Column, i: int) -> Column:
    return F.get(F.split(name, "_"), F.lit(i))


def leg_name(name: Column) -> Column:
    """A folder name with the year of its period dropped."""
    return F.regexp_replace(name, r"^\d{4}(\d{4})", "$1")


def who_text(names: Column, cap: int, many: str) -> Column:
    return F.when(F.size(names) <= cap, F.array_join(names, "+")).otherwise(F.lit(many))


def _units(text: str) -> int:
    """Wide characters count one each, runs of other letters and digits one a run."""
    count, inside = 0, False
    for ch in text:
        if unicodedata.east_asian_width(ch) in "WF":
            count, inside = count + 1, False
        elif ch.isalnum():
            count, inside = count + (not inside), True
        else:
            inside = False
    return count


def _all_units(names: pd.Series) -> pd.Series:
    return names.map(lambda x: _units(x or "")).astype("int32")


def name_units(name: Column) -> Column:
    return F.pandas_udf(_all_units, "int")(name)


def name_problems(name: Column, hard: int) -> Column:
    """Problems of a folder name, comma-separated; empty if it has none."""
    head = slot(name, 0)
    return F.concat_ws(
        ",",
        F.when(~head.rlike(r"^(\d{8}(-\d{4})?|\d{4}00|\d{6}00)?$"), "bad_period"),
        F.when(name.rlike(r'[<>:"|?*\\/]'), "illegal_character"),
        F.when(name.rlike(r"__|_$"), "empty_slot"),
        F.when(name_units(name) > hard, "too_long"),
    )


def preferred_tag(tags: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_element_at(tags, F.lit(k)) for k in order])


def place_kind(tags: Column) -> Column:
    has = lambda k, *v: F.coalesce(F.try_element_at(tags, F.lit(k)).isin(*v), F.lit(False))
    return (
        F.when(has("amenity", "restaurant", "cafe", "fast_food", "bar"), "eatery")
        .when(has("tourism", "hotel", "hostel", "guest_house"), "stay")
        .when(has("tourism", "attraction", "museum", "viewpoint"), "sight")
        .when(F.map_contains_key(tags, "highway"), "street")
    )


def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def folded(name: Column) -> Column:
    """A name regardless of letter case and width (no built-in function normalises so)."""
    return F.pandas_udf(_folded, "string")(name)


def near_names(rows: DataFrame, name: str) -> DataFrame:
    """(first, second, distance) of different names that are equal once folded, or one edit apart where
    both have four characters or more. Names within one edit share a key: the name itself or the
    name without one of its characters. So the join is an equi-join on these keys."""
    own = rows.select(F.col(name).alias("w")).where("w is not null").distinct().select("w", folded(F.col("w")).alias("f"))
    drop = F.transform(F.sequence(F.lit(1), F.length("f")), lambda i: F.concat(F.substring("f", F.lit(1), i - 1), F.substring("f", i + 1, F.length("f"))))
    keys = F.when(F.length("f") >= 4, F.array_distinct(F.concat(F.array("f"), drop))).otherwise(F.array("f"))
    keyed = own.select("w", "f", F.explode(keys).alias("k"))
    left, right = keyed.select("k", F.col("w").alias("first"), F.col("f").alias("f1")), keyed.select("k", F.col("w").alias("second"), F.col("f").alias("f2"))
    met = left.join(right, "k").where("first < second").withColumn("distance", F.levenshtein("f1", "f2"))
    close = (F.col("distance") == 0) | ((F.col("distance") == 1) & (F.least(F.length("f1"), F.length("f2")) >= 4))
    return met.where(close).select("first", "second", "distance").distinct()
