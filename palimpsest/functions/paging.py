"""Page lists, color modes and settings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Color modes, in the order of the job file's page lists.
MODES = ("bw", "grayscale", "rgb", "skip")
#: Settings where neither the job nor the settings file says otherwise.
DEFAULTS = {"color_mode": "rgb", "dpi": 300, "fg_dpi": 100, "bg_quality": 50, "fg_quality": 30, "parallel_workers": 0, "cache_dir": ".cache", "linearize": True}


def page_range(spec: Column) -> Column:
    """struct(pages, error) of a list such as ``1, 3, 5-10``: sorted, distinct.

    error is NULL where the list is valid, else what is wrong with it."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    numbers = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"^(\d+)\s*(-.*)?$", 1).try_cast("bigint").alias("low"),
            F.regexp_extract(p, r"^(?:\d+\s*-\s*)?(\d+)$", 1).try_cast("bigint").alias("high"),
        ),
    )
    bad = F.exists(numbers, lambda n: n["low"].isNull() | n["high"].isNull() | (n["high"] > 4294967295) | (n["low"] > 4294967295))
    backwards = F.exists(numbers, lambda n: n["low"] > n["high"])
    error = (
        F.when(F.trim(spec) == "", "empty range")
        .when(bad, "not a page number")
        .when(backwards, "start after end")
        .when(F.size(parts) == 0, "no pages")
    )
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(numbers, lambda n: F.sequence(n["low"], n["high"])))))
    return F.struct(F.when(error.isNull(), pages).alias("pages"), error.alias("error"))


def merged(job: Column, setting: Column, default=None) -> Column:
    """The job's value, else the settings', else the default."""
    return F.coalesce(job, setting, *([] if default is None else [F.lit(default)]))


def resolve_modes(lists: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, mode, error) of (keys, page, mode) rows: error names both
    modes where a page is in two lists."""
    grouped = lists.groupBy(*keys, "page").agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    clash = F.when(F.size("modes") > 1, F.concat(F.lit("page in two lists: "), F.array_join("modes", ", ")))
    return grouped.select(*keys, "page", F.element_at("modes", 1).alias("mode"), clash.alias("error"))


def page_modes(pages: DataFrame, overrides: DataFrame, keys: list[str], default: Column) -> DataFrame:
    """pages with ``mode``: the override where there is one, else the default."""
    return pages.join(overrides.select(*keys, "mode"), keys, "left").withColumn("mode", F.coalesce("mode", default))


def canonical_settings(color_mode: Column, dpi: Column, fg_dpi: Column, bg_quality: Column, fg_quality: Column) -> Column:
    """Settings as JSON with keys in alphabetical order."""
    return F.to_json(
        F.struct(
            bg_quality.cast("int").alias("bg_quality"), color_mode.alias("color_mode"), dpi.cast("int").alias("dpi"),
            fg_dpi.cast("int").alias("fg_dpi"), fg_quality.cast("int").alias("fg_quality"),
        )
    )


def cache_key(path: Column, page_index: Column, content: Column, settings: Column) -> Column:
    """SHA-256 of path, little-endian 32-bit page index, content and settings."""
    big = F.lpad(F.hex(page_index.cast("bigint")), 8, "0")
    little = F.unhex(F.concat(*[F.substring(big, k, 2) for k in (7, 5, 3, 1)]))
    return F.sha2(F.concat(path.cast("binary"), little, content.cast("binary"), settings.cast("binary")), 256)


def valid_key(key: Column) -> Column:
    return key.rlike("^[0-9a-f]{64}$")
