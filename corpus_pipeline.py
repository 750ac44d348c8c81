"""A corpus pipeline of five stages over documents.

Each stage is (spark, docs, sf_dir) -> DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it back as the next stage's docs. All
stages but the last return the columns of documents.

* language_id drops texts without letters, and texts of ``LEAST_LETTERS`` letters or
  more of which no language stands out: the best one's mean probability over all
  bytes lies less than ``LEAST_MARGIN`` of the way from an even chance to certainty.
  A shorter text says too little to be turned away.
* line_dedup removes repeated content-defined chunks of lines and, grown from them by
  an exact step, all repeated runs of two lines or more; n_chars follows the text.
  Documents of which that leaves no word are dropped: all they said is elsewhere.
* ngram_jaccard keeps one document, the one of least doc_id, of each class.
* decontaminate drops documents that the benchmark contaminates.
* pack gives one row for each token piece with its sequence and offset. Sequences
  are long, ``SEQUENCE`` tokens, and hold at most ``DOCUMENTS`` pieces and an
  attention cost (sum of squared lengths) of ``COST``; all three capacities bind.

Rows of any stage: null texts go in the first stage (no letters); empty ones too.
Repeated rows and rows that share an id are documents of their own until
ngram_jaccard, which keeps one. An empty table gives empty tables. Very long texts
are worked on whole. Columns beside those of ``documents``, whatever they are called,
travel in a struct and come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common, decontam, language_id, line_dedup, ngram_join, packing

LEAST_MARGIN = 0.2
LEAST_LETTERS = 20
#: Tokens, pieces and attention cost of a packed sequence; pieces have 2,048 tokens at most.
SEQUENCE, DOCUMENTS, COST = 8192, 32, 3 * 2048**2


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", F.struct("*").alias("doc"))
    found = language_id.identify(rows, keep=("doc",))
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    unclear = (F.col("score") < language_id.margin(LEAST_MARGIN)) & (letters >= LEAST_LETTERS)
    return found.where((F.col("lang_pred") != "und") & ~unclear).select("doc.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_runs(docs.select("doc_id", "text", F.struct("*").alias("doc")))
    changed = F.col("_n_removed") > 0
    values = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("doc.n_chars"))}
    kept = [values.get(c.lower(), F.col("doc").getField(c)).alias(c) for c in docs.columns]
    return found.where(~(changed & ~F.col("text").rlike(r"\S"))).select(*kept)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = common.numbered(docs.select("doc_id", "text", F.struct("*").alias("doc")))
    first = ngram_join.near_duplicates(rows, row="_row").where("is_first").select(F.col("row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select("doc.*")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.judge(decontam.find_hits(docs, benchmark, carry=True)).where("not contaminated").select("doc.*")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.staged_pieces(docs), SEQUENCE, DOCUMENTS, COST, weights=(1.0, 0.2, 0.2))


STAGES = [
    ("language_id", language_id_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: SQL can't express the first stage's network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
