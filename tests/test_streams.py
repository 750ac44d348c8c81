from pyspark.sql import functions as F

from palimpsest.operators import blocks, pages, streams
from palimpsest.sources.fonts import font_table
from tests.pdf_samples import sample

STREAM = b"q 1 g 0 0 50 50 re f Q BT /F1 24 Tf 100 700 Td (Hi) Tj ET q 100 0 0 100 0 0 cm /Im0 Do Q q 10 0 0 10 400 400 cm /Im1 Do Q"


def test_streams(spark):
    jobs = spark.createDataFrame([(1, bytearray(sample([STREAM, b"", b"(open"])), "rgb", {2: "skip"}), (2, bytearray(b"no"), "rgb", None)], "job long, data binary, color_mode string, overrides map<int,string>")
    split = pages.split_pages(jobs).persist()
    assert [(r.job, r.page) for r in split.where("error is not null").collect()] == [(2, -1)]
    held = split.where("content is not null")
    ops = streams.operations(held)
    assert [r.page for r in ops.where("error is not null").collect()] == [2]
    kept = blocks.strip_blocks(ops.where("error is null"), ["job", "page"], "seq", F.col("operator") == "BT", F.col("operator") == "ET")
    assert {r.operator for r in kept.collect()} == {"q", "Q", "g", "re", "f", "cm", "Do"}
    (shown,) = streams.text(held).where("error is null").collect()
    assert (shown.font, shown.codes, shown.x, shown.y) == ("F1", [72, 105], 100, 700)
    (hit,) = streams.redactions(held).collect()
    assert hit.name == "Im0" and tuple(hit["mask"]) == (0, 0, 50, 50)


def test_font_table(spark):
    assert font_table(spark).where("ps = 'DejaVuSans'").count() == 1
