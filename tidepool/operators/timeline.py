"""Days, runs of days, stops and splits along time."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo


def fill_types(days: DataFrame, keys: list[str]) -> DataFrame:
    """Days without a type take their neighbours': the same on both sides, or ABROAD at an
    edge beside ABROAD, else HOME. keys partition the days; day orders them."""
    upto = lambda order: F.last("type", True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    before = upto("day")
    after = upto(F.desc("day"))  # a frame that ends at the last row would be read anew for each row
    edge = (before.isNull() & (after == "ABROAD")) | (after.isNull() & (before == "ABROAD"))
    return days.withColumn("type", F.coalesce("type", F.when(before == after, before).when(edge, "ABROAD").otherwise("HOME")))


def number_runs(days: DataFrame, keys: list[str], gap_days: int, jump_km: float) -> DataFrame:
    """Run numbers from 1: a run ends at a change of type, a long gap, or a far jump away from home."""
    w = Window.partitionBy(*keys).orderBy("day")
    lag = lambda c: F.lag(c).over(w)
    far = geo.haversine_km(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")) > jump_km
    cut = (
        lag("day").isNull()
        | (lag("type") != F.col("type"))
        | (F.datediff("day", lag("day")) > gap_days)
        | (F.col("type").isin("AWAY", "ABROAD") & F.coalesce(far, F.lit(False)))
    )
    return days.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("run", F.sum("cut").over(w)).drop("cut")


def sessions(rows: DataFrame, keys: list[str], at: Column, gap_seconds: int) -> DataFrame:
    """Gap sessions of each key: number, start, end and rows."""
    w = Window.partitionBy(*keys).orderBy("at")
    timed = rows.select(*keys, at.alias("at"))
    new = F.coalesce(F.timestamp_diff("MICROSECOND", F.lag("at").over(w), F.col("at")) > gap_seconds * 1_000_000, F.lit(True))
    numbered = timed.withColumn("new", new.cast("int")).withColumn("session", F.sum("new").over(w))
    return numbered.groupBy(*keys, "session").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("rows"))


def km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b, c, d = map(math.radians, (lat1, lon1, lat2, lon2))
    return 2 * P.EARTH_KM * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


class Middle:
    """Median of values that come one by one."""

    def __init__(self):
        self.values: list[float] = []

    def add(self, x: float) -> None:
        bisect.insort(self.values, x)

    def get(self) -> float:
        n = len(self.values)
        return (self.values[(n - 1) // 2] + self.values[n // 2]) / 2


def stops(points: DataFrame, keys: list[str]) -> DataFrame:
    """Stop number of each point (keys, id, at, lat, lon) along time: a new stop begins more
    than STOP_SPLIT_KM from the running median of the current one. The median depends on all
    points of the stop, which no window frame expresses; keys hold one day each."""

    def segment(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"], kind="stable")
        out, stop, lat, lon = [], 0, Middle(), Middle()
        for y, x in zip(pdf["lat"], pdf["lon"]):
            if not lat.values or km(y, x, lat.get(), lon.get()) > P.STOP_SPLIT_KM:
                stop, lat, lon = stop + 1, Middle(), Middle()
            lat.add(y)
            lon.add(x)
            out.append(stop)
        return pdf[[*keys, "id"]].assign(stop=np.array(out, np.int64))

    schema = ", ".join([*[f"{k} {t}" for k, t in points.dtypes if k in keys], f"id {dict(points.dtypes)['id']}", "stop long"])
    return points.groupBy(*keys).applyInPandas(segment, schema)


def split_runs(days: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Part of each day (keys, day, files, lat, lon) of a run: a part with more than `most`
    files is cut at its first farthest day-to-day jump; single days stay whole."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day").reset_index(drop=True)
        jumps = [0.0]
        for i in range(1, len(pdf)):
            place = pdf.loc[[i - 1, i], ["lat", "lon"]].to_numpy(float).ravel()
            jumps.append(0.0 if np.isnan(place).any() else km(*place))
        part, todo, number = np.zeros(len(pdf), np.int64), [(0, len(pdf))], 0
        while todo:
            a, b = todo.pop()
            if pdf["files"].iloc[a:b].sum() <= most or b - a == 1:
                number += 1
                part[a:b] = number
                continue
            at = a + 1 + int(np.argmax(jumps[a + 1 : b]))
            todo += [(at, b), (a, at)]
        return pdf[[*keys, "day"]].assign(part=part)

    schema = ", ".join([*[f"{k} {t}" for k, t in days.dtypes if k in keys], f"day {dict(days.dtypes)['day']}", "part long"])
    return days.groupBy(*keys).applyInPandas(split, schema)


def band_of(hour: Column) -> Column:
    """Time of day of an hour."""
    return F.when(hour.between(7, 10), "mostly morning").when(hour.between(11, 14), "mostly midday").when(hour.between(15, 18), "mostly late afternoon").otherwise("mostly after dark")


def upper_median_bands(rows: DataFrame, key: str, hour: Column) -> DataFrame:
    """(key, band): time of day of the upper median hour, from the count of each hour."""
    n = rows.groupBy(key, hour.alias("hour")).agg(F.count("*").alias("n"))
    own = Window.partitionBy(key)
    upto = n.withColumn("upto", F.sum("n").over(own.orderBy("hour"))).withColumn("all", F.sum("n").over(own))
    return upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(key).agg(band_of(F.min("hour")).alias("band"))


def drop_offs(rows: DataFrame, key: str, absent: int, least: int = 3) -> DataFrame:
    """(key, months, last_month, trailing) of keys that were seen in `least` months or more and in none
    of the last `absent` months or more. Only months that occur at all (yyyy-MM) count as positions;
    these few hundred rows at most are ranked in one task."""
    seen = rows.select(key, "month").distinct()
    place = seen.select("month").distinct().select("month", F.row_number().over(Window.orderBy(F.desc("month"))).alias("after"))
    own = seen.join(F.broadcast(place), "month").groupBy(key).agg(F.count("*").alias("months"), F.max("month").alias("last_month"), (F.min("after") - 1).cast("long").alias("trailing"))
    return own.where((F.col("months") >= least) & (F.col("trailing") >= absent))
