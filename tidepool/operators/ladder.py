"""The priority ladder and the draft store: picks and folds whose steps depend on each other."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import vectors
from tidepool.plans.stored import appended, shared_dir


def run_ladder(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Picks (key, id, rung) of each batch under its budget.

    rows: key, id, budget, medoid_rank (1 = medoid of the largest cluster, NULL otherwise),
    gray (score or NULL), outlier (similarity or NULL). Rung 1 takes medoids up to its share of
    the budget, rung 2 gray files by score, rung 3 outliers from the least alike, rung 4 the
    medoids that the share left out, rung 5 the rest by hash. Each row stands on its first rung,
    and a batch's first rows by rung are picked.
    """
    has = lambda x: F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    first = F.greatest(F.lit(1), F.least(F.col("budget"), F.bround(F.col("budget") * F.lit(share)).cast("int")))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.when(has("medoid_rank"), 0).otherwise(1), "medoid_rank", "id"))
    rung = F.when(has("medoid_rank") & (F.col("place") <= first), 1).when(has("gray"), 2).when(has("outlier"), 3).when(has("medoid_rank"), 4).otherwise(5)
    score = F.when(F.col("rung").isin(1, 4), F.col("medoid_rank").cast("double")).when(F.col("rung") == 2, -F.col("gray")).when(F.col("rung") == 3, F.col("outlier"))
    sha = F.when(F.col("rung") == 5, F.sha2(F.col("id").cast("string"), 256))
    picked = rows.withColumn("place", place).withColumn("rung", rung.cast("long"))
    at = F.row_number().over(Window.partitionBy(key).orderBy("rung", score, sha, "id"))
    return picked.withColumn("at", at).where(F.col("at") <= F.col("budget")).select(key, F.col("id").cast("long").alias("id"), "rung")


def fold_drafts(sightings: DataFrame, kind: str, tau: float) -> DataFrame:
    """(kind, seq, draft, state) of sightings (kind, seq, v) folded in order: one that is at least tau
    like a draft's first vector reinforces the most alike draft, else it starts a draft, whose vector
    never moves. Each step depends on the drafts before it; blocks of sightings meet the blocks
    of drafts so far, and only a block of each is held at once."""
    schema = f"{kind} {dict(sightings.dtypes)[kind]}, id long, v array<double>, blk long, draft long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, first, names, out = pdf.sort_values("id"), [], [], []
        for seq, v, best, to in zip(pdf["id"], pdf["v"], pdf["cos"], pdf["to"]):
            best, draft = (best, to) if best >= tau else (tau, None)
            cos = np.round(np.stack(first) @ v, 9) if first else np.zeros(0)
            if len(cos) and (cos.max() > best or draft is None and cos.max() >= tau):
                draft = names[int(cos.argmax())]
            if draft is None:
                first.append(np.asarray(v))
                names.append(seq)
            out.append(seq if draft is None else int(draft))
        return pdf[[kind, "id", "v", "blk"]].assign(draft=out)

    rows = sightings.select(kind, F.col("seq").cast("long").alias("id"), "v")
    done, drafts, path = None, None, f"{shared_dir(rows.sparkSession)}/drafts-{uuid.uuid4().hex}"
    for block in vectors.block_rounds(vectors.in_blocks(rows, kind, F.asc("id"))):
        near = vectors.beside(block, drafts, kind, lambda cos, e: cos)
        done = appended(near.groupBy(kind).applyInPandas(fold, schema), path)
        drafts = done.where("draft = id").select(kind, "id", "v", "blk", F.lit(0.0).alias("e"))
    if done is None:
        return rows.select(kind, F.col("id").alias("seq"), F.col("id").alias("draft"), F.lit("new").alias("state"))
    return done.select(kind, F.col("id").alias("seq"), "draft", F.when(F.col("draft") == F.col("id"), "new").otherwise("reinforced").alias("state"))
