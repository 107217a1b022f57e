"""The gate of question rounds: which checkpoints of a dump ask, as a batch fold and as a stateful stream.

A checkpoint asks if it brings `floor` new subjects and the dump's budget of `cap` rounds isn't spent. The end of a
dump asks once whatever it brings, and isn't charged. What a withheld checkpoint holds was not asked, so it is
new again at the next one; a reopened subject is always new.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidepool.plans.stored import shared_dir, stored

c = F.col
FLOOR, CAP = 3, 2
#: dump, checkpoint (orders the dump's rows), tiles and reopened (distinct subjects), final.
DECISION = "checkpoint long, fire boolean, why string, round int, new int, waiting int"


def gate(rows: DataFrame, floor: int = FLOOR, cap: int = CAP) -> DataFrame:
    """dump and DECISION of every checkpoint: a fold over each dump's checkpoints in order, of which there are few."""
    start = F.struct(F.lit(0).alias("fired"), F.array().cast("array<long>").alias("seen"), F.lit(False).alias("ended"), F.array().cast(f"array<struct<{DECISION.replace(' ', ':').replace(',:', ',')}>>").alias("out"))

    def decide(held: Column, x: Column, new: Column) -> Column:
        last = x["final"] & ~held["ended"]
        enough, left = new >= floor, held["fired"] < cap
        fire = last | (enough & left)
        why = F.when(last, "final").when(enough & ~left, "cap").otherwise("floor")
        made = F.struct(x["checkpoint"].alias("checkpoint"), fire.alias("fire"), why.alias("why"), (held["fired"] + 1).alias("round"), new.alias("new"), F.size(x["tiles"]).alias("waiting"))
        return F.struct(
            (held["fired"] + (fire & ~last).cast("int")).alias("fired"), F.when(fire, F.array_union(held["seen"], x["tiles"])).otherwise(held["seen"]).alias("seen"),
            (held["ended"] | last).alias("ended"), F.concat(held["out"], F.array(made)).alias("out"),
        )

    def step(held: Column, x: Column) -> Column:
        fresh = F.size(F.array_except(x["tiles"], held["seen"])) + F.size(F.array_intersect(F.array_intersect(x["tiles"], x["reopened"]), held["seen"]))
        return F.get(F.transform(F.array(fresh), lambda n: decide(held, x, n)), F.lit(0))

    ordered = F.array_sort(F.collect_list(F.struct("checkpoint", "tiles", "reopened", "final")))
    return rows.groupBy("dump").agg(F.aggregate(ordered, start, step)["out"].alias("out")).select("dump", F.inline("out"))


def resume(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The same for the checkpoints of a dump that arrive together; what was asked before is the state."""
    fired, seen, ended = (state.get[0], set(state.get[1]), state.get[2]) if state.exists else (0, set(), False)
    rows, out = pd.concat(list(parts)).sort_values("checkpoint", kind="stable"), []
    for r in rows.itertuples(index=False):
        tiles, again = set(r.tiles), set(r.reopened)
        new = len(tiles - seen) + len(tiles & again & seen)
        last = bool(r.final) and not ended
        fire = last or (new >= FLOOR and fired < CAP)
        why = "final" if last else "cap" if new >= FLOOR and fired >= CAP else "floor"
        out.append((key[0], r.checkpoint, fire, why, fired + 1, new, len(tiles)))
        fired, ended = fired + (fire and not last), ended or last
        seen |= tiles if fire else set()
    state.update((fired, sorted(int(x) for x in seen), ended))
    yield pd.DataFrame(out, columns=["dump", *[p.split(" ")[0] for p in DECISION.split(", ")]])


def live_gate(stream: DataFrame) -> DataFrame:
    """gate() of a stream; checkpoints of one dump arrive in order, each once."""
    key = dict(stream.dtypes)["dump"]
    return stream.groupBy("dump").applyInPandasWithState(resume, f"dump {key}, {DECISION}", "fired int, seen array<long>, ended boolean", "append", GroupStateTimeout.NoTimeout)


def run_gate(spark: SparkSession, folder: str, schema: StructType, out: str) -> DataFrame:
    """Decide what is new in folder since the last run with the same out, and return every decision so far. State and
    table live in out; a batch that is run again overwrites its own part. All files that are new make one batch, in which
    each dump's checkpoints are put in order, so what arrives together may lie in any number of files."""
    source = spark.readStream.schema(schema).parquet(folder)
    result = live_gate(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={number}")

    query = result.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/table").select(result.columns)


def streamed(rows: DataFrame, parts: int = 3) -> DataFrame:
    """gate() of rows as a stream that is stopped and taken up again: the checkpoints arrive in parts, and each
    part is a run of its own on the state that the one before left."""
    spark = rows.sparkSession
    where = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    rows = stored(rows, "checkpoints")  # read by the cuts and by each part
    cuts = rows.selectExpr(f"percentile_approx(checkpoint, array({', '.join(f'{k / parts}D' for k in range(1, parts))}), 1000) AS c").first().c or []
    found = None
    for low, high in zip([None, *sorted(set(cuts))], [*sorted(set(cuts)), None]):
        part = rows.where((F.lit(True) if low is None else c("checkpoint") > low) & (F.lit(True) if high is None else c("checkpoint") <= high))
        part.write.mode("append").parquet(f"{where}/rows")
        found = run_gate(spark, f"{where}/rows", rows.schema, where)
    return found
