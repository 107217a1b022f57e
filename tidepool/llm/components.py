"""Connected components of an edge table by alternating large and small stars.

Large star: every node hands the smallest id among itself and its neighbours to
its larger neighbours. Small star: it hands the smallest id to its smaller
neighbours. Both keep the components, and their fixpoint is one star a
component with the smallest id at its centre. Minima are grouped aggregates, which
map tasks take in part first. They are joined back on the node and a salt of the
neighbour, so the links of a hub are spread over SALTS tasks. Each round replaces
the table of the round before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SALTS = 32


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (a, b) with m of least (a, m)."""
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, ["a", "salt"]).drop("salt")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both.where("b > a"), least).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = _with_least(edges, least).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes with a link; component is the smallest node id.

    edges: long columns a and b in any order, repeats and loops allowed. An empty
    table gives an empty result.
    """
    start = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(start, "links")
    size = None
    while True:
        stats = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stats == size or not stats[0]:
            break
        size = stats
        old, now = now, materialize(_small(_large(now)), "stars")
        discard(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
