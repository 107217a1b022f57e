"""A catalogue of constraints: every rule fires, rows are read once."""

import tidepool.queries as queries
from pyspark.sql import functions as F
from tidepool.operators import constraints
from tidepool.queries import checks


def test_rules_are_evaluated_together(spark):
    rows = spark.createDataFrame([(1, None, 3), (2, "x/", 0), (3, "fine", 1), (4, "x/", None)], "id long, name string, n int")
    rules = [
        constraints.Rule("no-name", constraints.PROBLEM, F.col("name").isNull()), constraints.Rule("slash", constraints.PROBLEM, F.col("name").contains("/"), F.col("name")),
        constraints.Rule("none", constraints.WARNING, F.col("n") == 0),
    ]
    found = constraints.broken(rows, F.col("id"), rules)
    assert sorted(tuple(r) for r in found.collect()) == [("1", "no-name", "problem", ""), ("2", "none", "warning", ""), ("2", "slash", "problem", "x/"), ("4", "slash", "problem", "x/")]
    judged = {r.key: (r.problems, r.warnings, r.passes) for r in constraints.verdict(found, rows.select(F.col("id").alias("key"))).collect()}
    assert judged == {"1": (1, 0, False), "2": (1, 1, False), "3": (0, 0, True), "4": (1, 0, False)}
    assert constraints.broken(rows.limit(0), F.col("id"), rules).count() == 0


def test_every_rule_of_the_index_fires_in_one_scan_a_table(spark, sf_dir):
    found = queries.QUERIES["index_check"](spark, sf_dir)
    assert {(r.what, r.rule) for r in found.select("what", "rule").distinct().collect()} == {("folder", n) for n in checks.FOLDER_RULES} | {("file", n) for n in checks.FILE_RULES}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("events.parquet") <= 1 and plan.lower().count("relation [event") <= 1 and plan.lower().count("relation [c_custkey") <= 2
