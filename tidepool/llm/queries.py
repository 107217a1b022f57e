"""The queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    best_fit,
    bpe_prefix,
    fuse_dedup,
    laesa_codes,
    license_scan,
    pivot_topk,
    quality_mcd,
    separator_scan,
    simhash_vp,
    spelling_variants,
    substring_automaton,
    suffix_repeats,
    toxicity_weak,
)
from .common import table


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_topk.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return pivot_topk.top_k(vectors, F.col("id") % 100 == 0, 10)


def op2_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.verdicts(table(spark, sf_dir, "documents")).drop("distance")


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.repeat_digests(table(spark, sf_dir, "documents"))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.document_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


def op5_substring_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_automaton.window_digests(table(spark, sf_dir, "documents"))


def op6_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_prefix.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.default_templates(spark))


def op8_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_toxicity_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_weak.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fuse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse_dedup.copies(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op13_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivot_topk": op1_pivot_topk,
    "op2_quality_mcd": op2_quality_mcd,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_separator_scan": op4_separator_scan,
    "op5_substring_automaton": op5_substring_automaton,
    "op6_bpe_prefix": op6_bpe_prefix,
    "op7_license_scan": op7_license_scan,
    "op8_simhash_vp": op8_simhash_vp,
    "op9_best_fit": op9_best_fit,
    "op10_toxicity_weak": op10_toxicity_weak,
    "op11_fuse_dedup": op11_fuse_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_laesa_codes": op13_laesa_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_mcd": quality_mcd.oracle_sql(),
    "op7_license_scan": license_scan.oracle_sql(),
    "op11_fuse_dedup": fuse_dedup.ORACLE_SQL,
    "op12_spelling_variants": spelling_variants.ORACLE_SQL,
    "op13_laesa_codes": laesa_codes.oracle_sql(),
    "op1_pivot_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.r AS r, c.r AS vec_r, q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM scored
        WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id, vec_r)
        QUALIFY row_number() OVER w <= 10
    """,
}
