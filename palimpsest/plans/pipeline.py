"""Whole jobs: read, route, mask, assemble, write, report."""

from __future__ import annotations

import os
import shutil
import subprocess
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import paging
from palimpsest.operators import cache, pages
from palimpsest.sources import jobs as job_files

_JOBS = "job bigint, input string, output string, color_mode string, overrides map<int,string>, dpi int, bg_quality int, fg_quality int, linearize boolean"


def job_table(spark: SparkSession, jobs: list[dict[str, Any]]) -> DataFrame:
    """Merged jobs as rows, numbered from 0."""
    fields = [x.split(" ")[0] for x in _JOBS.split(", ")]
    return spark.createDataFrame([tuple(({"job": i} | j)[f] for f in fields) for i, j in enumerate(jobs)], _JOBS)


def with_data(spark: SparkSession, jobs: DataFrame, inputs: list[str]) -> DataFrame:
    """jobs with the bytes of their input; ``data`` is NULL where it is absent."""
    there = [p for p in dict.fromkeys(inputs) if _exists(spark, p)]
    if not there:
        return jobs.withColumn("data", F.lit(None).cast("binary"))
    files = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), F.col("content").alias("data"))
    key = F.regexp_replace("input", "^file:/+", "/")
    return jobs.withColumn("_path", key).join(files, "_path", "left").drop("_path")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def masked(spark: SparkSession, jobs: DataFrame, cache_path: str | None = None, render=None, partitions: int | None = None) -> DataFrame:
    """(job, data, pages, error) of jobs with data. Documents are split into pages,
    pages spread over the cluster, what the cache holds is left out, and each
    document is assembled in one group."""
    missing = jobs.where("data is null").select("job", F.lit(None).cast("binary").alias("data"), F.lit(0).alias("pages"), F.lit("input not found").alias("error"))
    present = jobs.where("data is not null")
    split = pages.split_pages(present)
    todo = split.where("error is null and mode <> 'skip'").join(present.select("job", "input", "dpi", "bg_quality", "fg_quality"), "job")
    settings = paging.canonical_settings(F.col("mode"), F.col("dpi"), F.col("dpi"), F.col("bg_quality"), F.col("fg_quality"))
    todo = todo.withColumn("key", paging.cache_key(F.col("input"), F.col("page"), F.col("content"), settings))
    todo = todo.repartition(partitions, "job", "page") if partitions else todo.repartition("job", "page")
    results = pages.skipped(split)
    if cache_path:
        hits, todo = cache.split_hits(todo, cache.read(spark, cache_path))
        results = results.unionByName(hits)
    made = pages.process_pages(todo, render)
    if cache_path:
        made = made.persist()
        cache.store(made, cache_path)
    return pages.assemble(present, results.unionByName(made)).unionByName(missing)


def write_outputs(results: DataFrame, jobs: DataFrame) -> None:
    """One file a job that succeeded, moved into place when whole."""

    def run(rows) -> None:
        from pyarrow import fs

        for row in rows:
            store, path = fs.FileSystem.from_uri(row["output"] if "://" in row["output"] else os.path.abspath(row["output"]))
            store.create_dir(os.path.dirname(path), recursive=True)
            with store.open_output_stream(path + ".part") as out:
                out.write(bytes(row["data"]))
            store.move(path + ".part", path)

    results.where("error is null").join(jobs.select("job", "output"), "job").select("output", "data").foreachPartition(run)


def linearize(path: str) -> None:
    """Rewrite a file for fast web view by the external tool."""
    tool = shutil.which("qpdf")
    if not tool:
        raise FileNotFoundError("qpdf is not installed")
    done = subprocess.run([tool, "--linearize", "--replace-input", path], capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"qpdf failed: {done.stderr.strip()}")


def report(results: DataFrame) -> DataFrame:
    """(status, jobs, pages)."""
    status = F.when(F.col("error").isNull(), "succeeded").otherwise("failed")
    return results.groupBy(status.alias("status")).agg(F.count("*").alias("jobs"), F.sum("pages").alias("pages"))


def run_jobs(spark: SparkSession, job_paths: list[str], cache_path: str | None = None, render=None) -> list[dict[str, Any]]:
    """Run all jobs of the job files and write their outputs; one row a job with
    its pages and error. A failed job does not stop the others."""
    merged = job_files.load_jobs(job_paths)
    jobs = with_data(spark, job_table(spark, merged), [j["input"] for j in merged]).persist()
    results = masked(spark, jobs, cache_path, render).persist()
    write_outputs(results, jobs)
    rows = {r["job"]: {"job": r["job"], "pages": r["pages"], "error": r["error"]} for r in results.select("job", "pages", "error").toLocalIterator()}
    for i, job in enumerate(merged):
        row = rows[i] | {"input": job["input"], "output": job["output"]}
        if job["linearize"] and row["error"] is None:
            try:
                linearize(job["output"])
            except (OSError, RuntimeError) as fault:
                row["linearize_error"] = str(fault)
        rows[i] = row
    results.unpersist()
    jobs.unpersist()
    return [rows[i] for i in sorted(rows)]
