"""Manifests and media files as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import parse
from tidepool.plans.stored import shared_dir


def media_files(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """path, name, size, modified (and content) of media files under a folder; dot folders are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(parse.is_media_name(name) & ~F.col("path").rlike(r"/\.[^/]+/"))
    extra = [F.col("content")] if with_content else []
    return kept.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *extra)


def hashed_tree(spark: SparkSession, folder: str, cache: DataFrame) -> DataFrame:
    """Files with sha256; a cached hash (path, size, modified, sha) is used while size and
    time agree, and content is read for the others only."""
    files = media_files(spark, folder)
    known = files.join(cache, ["path", "size", "modified"])
    fresh = media_files(spark, folder, with_content=True).join(known.select("path"), "path", "left_anti")
    return known.select("path", "name", "size", "modified", "sha").unionByName(fresh.withColumn("sha", F.sha2("content", 256)).drop("content"))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").option("emptyValue", "").mode("overwrite").csv(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest's text columns; columns that an old manifest lacks are NULL."""
    have = spark.read.option("header", "true").csv(path)
    want = spark.createDataFrame([], schema).columns
    return have.select(*[F.col(c) if c in have.columns else F.lit(None).cast("string").alias(c) for c in want])


def round_trip(rows: DataFrame, schema: str) -> DataFrame:
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    write_manifest(rows, path)
    return read_manifest(spark, path, schema)


def whole_scan(expected: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest, if it holds every expected (folder, file_name), copies counted; else an error, so
    that nothing is planned over a scan that missed files."""
    keys = ["folder", "file_name"]
    missed = expected.select(*keys).exceptAll(manifest.select(*keys)).count()
    if missed:
        raise ValueError(f"the scan missed {missed} files")
    return manifest
