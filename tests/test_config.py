import pytest
from pyspark.sql import functions as F

from palimpsest.functions import paging
from palimpsest.functions.paging import DEFAULTS
from palimpsest.sources.jobs import ConfigFault, load_jobs, page_overrides, parse_jobs, parse_pages, parse_settings

RANGES = {"21-24": [21, 22, 23, 24], "7": [7], "9, 2, 30-32, 2": [2, 9, 30, 31, 32], " 4 - 6 ,4,": [4, 5, 6]}
BAD = ["two", "8-3", "", " ", ",", "1-", "-3", "1-2-3"]


@pytest.mark.parametrize("spec", RANGES)
def test_ranges(spec):
    assert parse_pages(spec) == RANGES[spec]


@pytest.mark.parametrize("spec", BAD)
def test_bad_ranges(spec):
    with pytest.raises(ConfigFault):
        parse_pages(spec)


def test_range_column_agrees(spark):
    rows = spark.createDataFrame([(s,) for s in [*RANGES, *BAD]], "s string").select("s", paging.page_range(F.col("s")).alias("r")).collect()
    for row in rows:
        assert row.r.pages == RANGES.get(row.s)
        assert (row.r.error is None) == (row.s in RANGES)


def test_lists():
    assert parse_pages([8, 2, "11-12", 2]) == [2, 8, 11, 12]
    assert parse_pages(None) is None
    for bad in ([], [True], [1.5], {"a": 1}):
        with pytest.raises(ConfigFault):
            parse_pages(bad)


def test_settings():
    assert parse_settings("") == DEFAULTS
    assert parse_settings("dpi: 150\nother: 1")["dpi"] == 150
    with pytest.raises(ConfigFault):
        parse_settings("color_mode: pink")


def test_jobs_and_merge():
    (job,) = parse_jobs("jobs: [{input: a.pdf, output: b.pdf, dpi: 200, bw_pages: '1-2', skip_pages: [4]}]", {"dpi": 72, "bg_quality": 10}, "/x")
    assert (job["dpi"], job["bg_quality"], job["fg_quality"]) == (200, 10, 30)
    assert job["overrides"] == {1: "bw", 2: "bw", 4: "skip"} and job["input"] == "/x/a.pdf"
    for bad in ("jobs: [{input: a}]", "jobs: [{output: a}]", "a: 1", "jobs: [{input: a, output: b, color_mode: no}]"):
        with pytest.raises(ConfigFault):
            parse_jobs(bad)


def test_conflict():
    with pytest.raises(ConfigFault, match="bw and rgb"):
        page_overrides({"bw_pages": "6-9", "rgb_pages": [8]})


def test_discovery(tmp_path):
    (tmp_path / "j.yaml").write_text("jobs: [{input: a.pdf, output: b.pdf}]")
    assert load_jobs([str(tmp_path / "j.yaml")])[0]["dpi"] == 300
    (tmp_path / "settings.yaml").write_text("dpi: 99\ncache_dir: here")
    job = load_jobs([str(tmp_path / "j.yaml")])[0]
    assert job["dpi"] == 99 and job["cache_dir"] == "here"


def test_conflicts_as_rows(spark):
    rows = spark.createDataFrame([(1, 1, "bw"), (1, 1, "rgb"), (1, 2, "rgb"), (1, 2, "rgb")], "doc int, page int, mode string")
    got = {r.page: (r.mode, r.error) for r in paging.resolve_modes(rows, ["doc"]).collect()}
    assert got[2] == ("rgb", None) and "bw, rgb" in got[1][1]


def test_cache_key(spark):
    import hashlib

    s = '{"bg_quality":50,"color_mode":"rgb","dpi":300,"fg_dpi":150,"fg_quality":30}'
    df = spark.createDataFrame([("a.pdf", 258, bytearray(b"q Q"))], "path string, page long, content binary")
    settings = paging.canonical_settings(F.lit("rgb"), F.lit(300), F.lit(150), F.lit(50), F.lit(30))
    row = df.select(settings.alias("s"), paging.cache_key(F.col("path"), F.col("page"), F.col("content"), settings).alias("k")).first()
    assert row.s == s
    assert row.k == hashlib.sha256(b"a.pdf" + (258).to_bytes(4, "little") + b"q Q" + s.encode()).hexdigest()
