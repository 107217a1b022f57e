"""Exemplars that batches add to a stored memory: gates, an audit of every attempt, a cap, and runs that count once.

A memory is a folder. Each run writes the exemplars after it and the audit of its attempts, and last its place in the
order of runs; a run without a place didn't happen and may be repeated, and one with a place changes nothing when
it is repeated.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import params as P

c = F.col
EXEMPLAR = "subject long, ref long, seq long, v array<double>"
AUDIT = "seq long, subject long, ref long, decision string, gate string"
RUN = "place int, run string"
LEAST_NORM = 0.5


class Memory:
    """A stored memory: exemplars(), audit() and remember()."""

    def __init__(self, spark: SparkSession, folder: str, cap: int = P.EXEMPLAR_CAP):
        self.spark, self.folder, self.cap = spark, folder, cap

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def runs(self) -> list[str]:
        """Names of the runs in order; there are few."""
        if not self._exists("runs"):
            return []
        return [r.run for r in self.spark.read.schema(RUN).parquet(f"{self.folder}/runs").orderBy("place").collect()]

    def exemplars(self) -> DataFrame:
        done = self.runs()
        return self.spark.read.schema(EXEMPLAR).parquet(f"{self.folder}/exemplars/{done[-1]}") if done else self.spark.createDataFrame([], EXEMPLAR)

    def audit(self) -> DataFrame:
        """run and AUDIT of every attempt."""
        each = [self.spark.read.schema(AUDIT).parquet(f"{self.folder}/audit/{n}").withColumn("run", F.lit(n)) for n in self.runs()]
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], f"{AUDIT}, run string")

    def remember(self, run: str, looks: DataFrame, subjects: DataFrame, proofs: DataFrame, taken_out: DataFrame) -> bool:
        """Add a batch's looks (seq, subject, ref, v, provenance, sample) and say whether it is new.

        subjects (subject, status); proofs (sample, ref) of looks that can be shown; taken_out (subject, ref) that the owner
        took out. The first gate that fails is audited: provenance, evidence, subject, merged-into, unconfirmed, not-this,
        vector. What is held already, or offered twice, is audited as that.
        """
        done = self.runs()
        if run in done:
            return False
        held = self.exemplars()
        gated = gates(looks, subjects, proofs, taken_out)
        kept = grow(held, gated, self.cap)
        store = f"{self.folder}/grown/{run}"
        kept.write.mode("overwrite").parquet(store)
        grown = self.spark.read.schema(kept.schema).parquet(store)
        grown.where("what = 'exemplar'").select("subject", "ref", "seq", "v").write.mode("overwrite").parquet(f"{self.folder}/exemplars/{run}")
        refused = gated.where("gate is not null").select("seq", "subject", "ref", F.lit("refused").alias("decision"), "gate")
        told = grown.where("what = 'audit'").select("seq", "subject", "ref", "decision", F.lit(None).cast("string").alias("gate"))
        refused.unionByName(told).write.mode("overwrite").parquet(f"{self.folder}/audit/{run}")
        self.spark.createDataFrame([(len(done), run)], RUN).write.mode("append").parquet(f"{self.folder}/runs")
        return True


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))


def gates(looks: DataFrame, subjects: DataFrame, proofs: DataFrame, taken_out: DataFrame) -> DataFrame:
    """looks with gate, the first that refuses them (NULL if none)."""
    known = subjects.select("subject", c("status").alias("s_status")).dropDuplicates(["subject"])
    shown = proofs.select("sample", "ref").distinct().withColumn("proven", F.lit(True))
    out = taken_out.select("subject", "ref").distinct().withColumn("out", F.lit(True))
    met = looks.join(known, "subject", "left").join(shown, ["sample", "ref"], "left").join(out, ["subject", "ref"], "left")
    gate = (
        F.when(~c("provenance").eqNullSafe("viewed-image:"), "provenance")
        .when(c("proven").isNull(), "evidence")
        .when(c("s_status").isNull(), "subject")
        .when(c("s_status") == "merged-into", "merged-into")
        .when(c("s_status") != "confirmed", "unconfirmed")
        .when(c("out"), "not-this")
        .when(F.coalesce(norm(c("v")) < LEAST_NORM, F.lit(True)), "vector")
    )
    return met.select("seq", "subject", "ref", c("v").cast("array<double>").alias("v"), gate.alias("gate"))


def grow(held: DataFrame, gated: DataFrame, cap: int) -> DataFrame:
    """Exemplars after the accepted looks, which are added one after the other in the order of seq, and an audit row for
    each: over the cap the exemplar whose nearest neighbour is closest goes, so what a subject holds is bounded."""
    new = gated.where("gate is null").select(F.lit(True).alias("is_new"), "subject", "ref", "seq", "v")
    both = held.select(F.lit(False).alias("is_new"), "subject", "ref", "seq", "v").unionByName(new)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: dict[int, tuple[int, np.ndarray]] = {}
        out = []
        for r in pdf.sort_values(["is_new", "seq", "ref"], kind="stable").itertuples(index=False):
            if not r.is_new:
                kept[r.ref] = (r.seq, np.asarray(r.v))
                continue
            decision = "already-held" if r.ref in kept else "memorized"
            out.append(("audit", r.subject, r.ref, r.seq, None, decision))
            if decision == "memorized":
                kept[r.ref] = (r.seq, np.asarray(r.v) / np.linalg.norm(r.v))
                if len(kept) > cap:
                    refs = sorted(kept)
                    v = np.stack([kept[x][1] for x in refs])
                    alike = np.round(v @ v.T, 9)
                    np.fill_diagonal(alike, -1.0)
                    del kept[refs[int(alike.max(axis=1).argmax())]]
        out += [("exemplar", pdf["subject"].iloc[0], ref, seq, v, None) for ref, (seq, v) in kept.items()]
        return pd.DataFrame(out, columns=["what", "subject", "ref", "seq", "v", "decision"])

    return both.groupBy("subject").applyInPandas(add, "what string, subject long, ref long, seq long, v array<double>, decision string")
