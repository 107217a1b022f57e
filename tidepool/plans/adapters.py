"""Typed views with the shape of a photo archive over the given tables.

The views' text is plain SQL that Spark and the oracle read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import parse

MANIFEST = """
SELECT event_id AS file_no,
  'f' || lpad(CAST(user_id % 40 AS STRING), 2, '0') AS folder,
  CASE WHEN event_id % 29 = 0 THEN '._IMG_' WHEN event_id % 17 = 0 THEN 'Screenshot_'
       WHEN event_id % 19 = 0 THEN 'IMG-20240101-WA' ELSE 'IMG_' END
    || lpad(CAST(event_id % 4000 AS STRING), 4, '0')
    || CASE event_id % 7 WHEN 0 THEN '.heic' WHEN 1 THEN '.PNG' WHEN 2 THEN '.mov' WHEN 3 THEN '.mp4' WHEN 6 THEN '.aae' ELSE '.jpg' END AS file_name,
  CASE event_id % 7 WHEN 0 THEN 'HEIC' WHEN 1 THEN 'PNG' WHEN 2 THEN 'MOV' WHEN 3 THEN 'MP4' ELSE 'JPEG' END AS file_type,
  CASE WHEN event_id % 101 = 0 THEN '0 bytes' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS STRING) END AS file_size,
  CASE WHEN event_id % 11 = 0 THEN '-' WHEN event_id % 13 = 0 THEN '0000:00:00 00:00:00' WHEN event_id % 53 = 0 THEN '2024:13:40 99:00:00'
       ELSE replace(substr(CAST(ts AS STRING), 1, 10), '-', ':') || substr(CAST(ts AS STRING), 11, 9) END AS date_time_original,
  CASE WHEN event_id % 5 = 0 THEN '-' ELSE replace(substr(CAST(ts AS STRING), 1, 10), '-', ':') || ' 12:00:00' END AS create_date,
  CASE event_id % 4 WHEN 0 THEN '+08:00' WHEN 1 THEN '+0900' WHEN 2 THEN '-' ELSE '-03:30' END AS offset_original,
  CASE WHEN event_id % 9 = 0 THEN '-' WHEN event_id % 97 = 0 THEN '0, 0'
       WHEN event_id % 61 = 0 THEN '25.' || CAST(50 + event_id * 7 % 50 AS STRING) || ' 122.' || lpad(CAST(user_id * 13 % 100 AS STRING), 2, '0')
       ELSE '25.' || lpad(CAST(k % 50 - k % 5 + k % 2 AS STRING), 2, '0') || CASE WHEN event_id % 2 = 0 THEN ', ' ELSE ' ' END
         || '121.' || lpad(CAST(user_id % 25 * 2 AS STRING), 2, '0') END AS gps_position,
  CASE event_id % 6 WHEN 0 THEN '-' WHEN 1 THEN 'Apple' WHEN 2 THEN 'Canon' WHEN 3 THEN '' WHEN 4 THEN 'samsung' ELSE 'Apple' END AS make,
  CASE event_id % 6 WHEN 0 THEN '-' WHEN 1 THEN 'iPhone 12' WHEN 2 THEN 'EOS' WHEN 3 THEN '-' WHEN 4 THEN 'SM-N975F' ELSE 'iPhone 15' END AS model,
  CASE event_id % 8 WHEN 0 THEN '1170' WHEN 1 THEN '4032' WHEN 2 THEN '1280' WHEN 3 THEN '6000' WHEN 4 THEN '-' WHEN 5 THEN '1080' ELSE '3024' END AS width,
  CASE event_id % 8 WHEN 0 THEN '2532' WHEN 1 THEN '3024' WHEN 2 THEN '960' WHEN 3 THEN '4000' WHEN 4 THEN '-' WHEN 5 THEN '2400' ELSE '4032' END AS height,
  substr(CAST(ts AS STRING), 1, 19) AS modified,
  ts
FROM (SELECT event_id, user_id, event_type, value, props, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
    ts + INTERVAL '1' MONTH * CAST(event_id % (1 + user_id % 5) AS INT) AS ts FROM events) e
"""

TYPED = """
SELECT m.*, taken, CAST(taken AS DATE) AS day, strftime(taken, '%Y-%m') AS month,
  hour(taken) IN (19, 20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6) AS night,
  CASE WHEN ok THEN glat END AS lat, CASE WHEN ok THEN glon END AS lon
FROM (
  SELECT *, coalesce(try_strptime(CASE WHEN date_time_original NOT IN ('-', '', '0000:00:00 00:00:00') THEN substr(date_time_original, 1, 19) END, '%Y:%m:%d %H:%M:%S'),
                     try_strptime(CASE WHEN create_date NOT IN ('-', '', '0000:00:00 00:00:00') THEN substr(create_date, 1, 19) END, '%Y:%m:%d %H:%M:%S')) AS taken,
    try_cast(split_part(replace(replace(gps_position, ', ', ' '), ',', ' '), ' ', 1) AS DOUBLE) AS glat,
    try_cast(split_part(replace(replace(gps_position, ', ', ' '), ',', ' '), ' ', 2) AS DOUBLE) AS glon,
    glat IS NOT NULL AND glon IS NOT NULL AND NOT (glat = 0 AND glon = 0) AS ok
  FROM manifest) m
"""

CTE = f"WITH manifest AS ({MANIFEST}), typed AS ({TYPED})"

#: id, lat, lon, since, until, label
HOMES = [
    ("h1", 25.10, 121.10, None, None, "north"),
    ("h2", 25.30, 121.30, "2024-01-10", "2024-01-20", None),
    ("h3", 25.45, 121.05, "bad", "2024", "south"),
]
#: id, lat, lon, label
NAMED = [("n1", 25.20, 121.20, "lake"), ("n2", 25.25, 121.21, "hill"), ("n3", 25.40, 121.40, "market")]


def values(rows: list[tuple], columns: str) -> str:
    """Literal rows for the oracle."""
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns}))"


HOMES_SQL = values(HOMES, "id, hlat, hlon, since, until, label")
NAMED_SQL = values(NAMED, "id, nlat, nlon, label")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MANIFEST.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir)
    # the view's texts are long, and the parsers name them often: each is bound once
    point = parse.let(F.col("gps_position"), parse.gps)
    taken = F.coalesce(*[parse.let(F.col(n), parse.stamp) for n in ("date_time_original", "create_date")])
    return rows.withColumn("taken", taken).select(
        *rows.columns,
        "taken",
        F.to_date("taken").alias("day"),
        F.date_format("taken", "yyyy-MM").alias("month"),
        parse.is_night(F.col("taken")).alias("night"),
        point["lat"].alias("lat"),
        point["lon"].alias("lon"),
    )


def homes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOMES, "id string, hlat double, hlon double, since string, until string, label string")


def named(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMED, "id string, nlat double, nlon double, label string")
