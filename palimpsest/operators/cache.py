"""Content-addressed results: a Parquet table keyed by page content and settings.

Readable rows that fit, page size included, are hits; anything else is a miss.
Results are appended, and of one key the latest write counts, so a rerun that writes
again does no harm; ``compact`` leaves only the rows that count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.paging import valid_key
from palimpsest.operators.pages import RESULTS, _spark_schema



def _held() -> list:
    return [f for f in _spark_schema(RESULTS) if f.name not in ("job", "page", "error")]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Cached rows by key; an absent table is empty."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _held()) + ", written timestamp"
    if not there:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(path).where(valid_key(F.col("key")))


#: Points by which a held page's sides may differ from the page's.
SIZE_TOLERANCE = 0.01


def latest(cached: DataFrame) -> DataFrame:
    """One row, the last written, of each key and mode."""
    on = ["key", "mode"]
    last = cached.groupBy(*on).agg(F.max("written").alias("written"))
    return cached.join(last, [*on, "written"]).dropDuplicates(on)


def split_hits(pages: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits as RESULTS, pages without one): the key, the mode and the page's size
    must match, and the result be whole."""
    on = ["key", "mode"]
    one = latest(cached)
    held = [f.name for f in _held() if f.name not in (*on, "width", "height")]
    one = one.select(*on, F.col("width").alias("_w"), F.col("height").alias("_h"), *held)
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= SIZE_TOLERANCE
    hits = pages.select("job", "page", "width", "height", *on).join(one, on).where(near("width", "_w") & near("height", "_h"))
    hits = hits.select(*[F.lit(None).cast("string").alias("error") if f.name == "error" else F.col(f.name) for f in _spark_schema(RESULTS)])
    return hits, pages.join(hits.select("job", "page"), ["job", "page"], "left_anti")


def compact(spark: SparkSession, path: str) -> None:
    """Rewrite the table with the latest row of each key, then swap it in."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    now, new, old = fs_path(path), fs_path(path + ".compact"), fs_path(path + ".before")
    store_of = now.getFileSystem(spark._jsc.hadoopConfiguration())
    latest(read(spark, path)).write.mode("overwrite").parquet(path + ".compact")
    store_of.rename(now, old)
    store_of.rename(new, now)
    store_of.delete(old, True)


def store(results: DataFrame, path: str) -> None:
    """Append what succeeded and isn't a plain copy."""
    good = results.where("error is null and kind is not null and key is not null")
    good.select(*[f.name for f in _held()]).withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)


def contains(keys: DataFrame, cached: DataFrame) -> DataFrame:
    """The keys that the cache holds."""
    return keys.join(cached.select("key"), "key", "left_semi")
