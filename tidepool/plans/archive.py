"""Views of subjects, looks and plan rows over the given tables, in SQL that Spark and the oracle read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import adapters as A

SUBJECTS = """
SELECT s_suppkey AS no, 'subj-' || lpad(CAST(s_suppkey AS STRING), 4, '0') AS subject_id, CASE WHEN s_suppkey % 6 <> 5 THEN s_name END AS name,
  CASE WHEN s_nationkey % 2 = 0 THEN 'cat' ELSE 'dog' END AS kind,
  CASE WHEN s_acctbal < 0 THEN 'rejected' WHEN s_acctbal < 2500 THEN 'draft' WHEN s_acctbal < 4000 THEN 'merged-into' ELSE 'confirmed' END AS status,
  CASE WHEN s_acctbal >= 2500 AND s_acctbal < 4000 THEN CAST(floor(s_suppkey / 2) AS BIGINT) END AS merged_into,
  CAST(abs(floor(s_acctbal)) AS BIGINT) % 97 AS files, CAST(abs(floor(s_acctbal)) AS BIGINT) % 5 AS ungated,
  CASE WHEN s_suppkey % 7 = 0 THEN true WHEN s_suppkey % 7 = 1 THEN false END AS forms, s_nationkey % 3 > 0 AS has_start, s_suppkey % 11 = 0 AS asked_away, s_nationkey % 10 AS label
FROM supplier
"""

LOOKS = """
SELECT event_id AS file_no, user_id % 40 AS batch, 'f' || lpad(CAST(user_id % 40 AS STRING), 2, '0') AS folder, (user_id * 3 + event_id % 4) % 100 AS subject_no,
  CASE event_type WHEN 'click' THEN 'viewed-image:' WHEN 'view' THEN 'clip-matched:' WHEN 'error' THEN 'viewed-image' WHEN 'login' THEN 'clip-propagated:' ELSE 'draft:viewed-image:' END AS provenance,
  CASE WHEN event_id % 13 = 0 THEN 'guess:' ELSE 'viewed-image:' END AS claimed, 's' || CAST(event_id % 997 AS STRING) AS sample, ts, value
FROM events
"""


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SUBJECTS.replace("FROM supplier", "FROM {t}"), t=A.table(spark, sf_dir, "supplier"))


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOOKS.replace("FROM events", "FROM {t}"), t=A.table(spark, sf_dir, "events"))


CTE = f"WITH subjects AS ({SUBJECTS}), looks AS ({LOOKS})"
