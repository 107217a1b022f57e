"""Structured Streaming forms of the day rollup and of gap sessions.

An extension: the batch operators define the results. Each run reads what is there
(availableNow), keeps its state in the shared folder and leaves a table there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.plans.stored import shared_dir


def _run(spark: SparkSession, sf_dir: str, table: str, build, mode: str) -> DataFrame:
    # the table's own path, which may be one file or a folder of part files
    name = f"{table}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}").schema)
    stream = source.parquet(f"{sf_dir}/{name}") if folder else source.option("pathGlobFilter", name).parquet(sf_dir)
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    result = build(stream)

    def put(batch: DataFrame, number: int) -> None:
        # complete mode hands over the whole result, append mode its new rows: a batch
        # that is run again overwrites its own folder
        where = f"{out}/table" if mode == "complete" else f"{out}/table/batch={number}"
        batch.write.mode("overwrite").parquet(where)

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/table").select(result.columns)


def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and sum of values of each day and type."""

    def build(stream: DataFrame) -> DataFrame:
        day = F.date_format("ts", "yyyy-MM-dd").alias("day")
        return stream.groupBy(day, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))

    return _run(spark, sf_dir, "events", build, "complete")


def live_sessions(spark: SparkSession, sf_dir: str, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Closed sessions of each user by event time. Append mode: a session is written, and its state
    dropped, once the watermark (the latest event less `late`) has passed its end, so sessions that may
    still grow are not there yet."""

    def build(stream: DataFrame) -> DataFrame:
        timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
        return timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
            "user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"
        )

    return _run(spark, sf_dir, "events", build, "append")
