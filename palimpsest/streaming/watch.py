"""Masking documents as they arrive in a folder.

Each micro-batch of new files goes through the batch plan; the cache makes a batch
that runs again after a failure cheap, and an output is written whole or not at
all.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.paging import DEFAULTS
from palimpsest.plans import pipeline


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, cache_path: str | None = None, render=None, settings: dict | None = None):
    """A streaming query over source/*.pdf; outputs go to target by file name."""
    chosen = DEFAULTS | (settings or {})
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.pdf").load(source)

    def batch(df: DataFrame, _: int) -> None:
        jobs = df.select(
            F.xxhash64("path").alias("job"), F.col("path").alias("input"), F.concat(F.lit(target.rstrip(os.sep) + "/"), F.element_at(F.split("path", "/"), -1)).alias("output"),
            F.lit(chosen["color_mode"]).alias("color_mode"), F.lit(None).cast("map<int,string>").alias("overrides"),
            *[F.lit(chosen[k]).alias(k) for k in ("dpi", "bg_quality", "fg_quality", "linearize")], F.col("content").alias("data"),
        ).persist()
        pipeline.write_outputs(pipeline.masked(spark, jobs, cache_path, render), jobs)
        jobs.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
