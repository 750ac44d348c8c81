"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language_id, line_dedup, lm_score, ngram_join, oracles, packing, secret_scan, substring_dedup, token_counts, vector_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.judge(decontam.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return hits.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "file", "doc_number", "start", "terminated")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", "n_grams")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in secret_scan.KINDS]
    base = F.sha2(secret_scan.listed(secret_scan.KINDS[:3]), 256).alias("base_sha256")
    return found.select("doc_id", *counts[:3], base, secret_scan.listed(secret_scan.KINDS).alias("spans"), counts[3])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), digest)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def queries() -> dict:
    return {
        "op1_pack": op1_pack,
        "op2_decontaminate": op2_decontaminate,
        "op3_token_counts": op3_token_counts,
        "op4_lm_score": op4_lm_score,
        "op5_ngram_join": op5_ngram_join,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_secret_scan": op7_secret_scan,
        "op8_line_dedup": op8_line_dedup,
        "op9_language_id": op9_language_id,
        "op10_vector_search": op10_vector_search,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
