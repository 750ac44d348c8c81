"""Content streams as tables: operators, placements, white rectangles, text.

Each takes pages (job, page, content) and gives rows keyed by (job, page, seq), so
that windows and joins of ``blocks`` and ``boxes`` apply to real pages. A stream
that can't be read gives one row with its error and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import geometry
from palimpsest.operators import boxes

_KEY = "job bigint, page int, seq int"


def _rows(pages: DataFrame, schema: str, make: Callable[[bytes], list[tuple]]) -> DataFrame:
    """One row for each tuple that make gives for a page's content."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"{_KEY}, {schema}, error string"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        width = len(arrow) - 4
        for batch in batches:
            for job, page, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = [(job, page, i, *row, None) for i, row in enumerate(make(data or b""))]
                except ValueError as fault:
                    found = [(job, page, -1, *[None] * width, str(fault))]
                columns = list(zip(*found, strict=True)) or [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return pages.select("job", "page", "content").mapInArrow(run, ddl)


def operations(pages: DataFrame) -> DataFrame:
    """(job, page, seq, operator, operands): operands in their written form."""

    def make(data: bytes) -> list[tuple]:
        from palimpsest.sources.pdf_syntax import operations as read
        from palimpsest.sources.pdf_syntax import written

        return [(operator, [written(o).decode("latin-1") for o in operands]) for operator, operands in read(data)]

    return _rows(pages, "operator string, operands array<string>", make)


def _boxed(df: DataFrame) -> DataFrame:
    return df.withColumn("box", geometry.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).drop("x0", "y0", "x1", "y1")


def placements(pages: DataFrame) -> DataFrame:
    """(job, page, seq, name, box) of the XObjects drawn."""

    def make(data: bytes) -> list[tuple]:
        from palimpsest.functions import content

        return [(name, *box) for name, _, box in content.placements(data)]

    return _boxed(_rows(pages, "name string, x0 double, y0 double, x1 double, y1 double", make))


def white_rects(pages: DataFrame) -> DataFrame:
    """(job, page, seq, box) of the white rectangles."""

    def make(data: bytes) -> list[tuple]:
        from palimpsest.functions import content

        return [tuple(box) for box in content.white_rects(data)]

    return _boxed(_rows(pages, "x0 double, y0 double, x1 double, y1 double", make))


def text(pages: DataFrame) -> DataFrame:
    """(job, page, seq, font, size, codes, x, y): what is shown, and where."""

    def make(data: bytes) -> list[tuple]:
        from palimpsest.functions import content

        out = []
        for c in content.text_commands(data):
            m = content.times(c["text_matrix"], c["ctm"])
            out.append((c["font"], c["size"], c["codes"], m[4], m[5]))
        return out

    return _rows(pages, "font string, size double, codes array<int>, x double, y double", make)


def redactions(pages: DataFrame, cell: float = 144.0) -> DataFrame:
    """(job, page, name, placed, mask): images and the white rectangles over
    them, by an equi join on page and grid cell."""
    images = placements(pages).where("error is null").select("job", "page", "name", F.col("box").alias("placed"))
    masks = white_rects(pages).where("error is null").select("job", "page", F.col("box").alias("mask"))
    return boxes.overlap_join(images, masks, ["job", "page"], "placed", "mask", cell)
