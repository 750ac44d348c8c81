"""Documents to pages, pages to masked pages, masked pages to documents.

Every step is one Arrow map or one group a document. A page travels as a small
document of its own, so its work needs nothing else; bitmaps are made and used
inside one map and never leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = (
    "job bigint, page int, mode string, width double, height double, content binary, page_doc binary, error string"
)
OUTPUT = (
    "kind string, content binary, images array<struct<name:string,data:binary,filter:string,space:string,bits:int>>, "
    "regions array<struct<data:binary,x0:double,y0:double,x1:double,y1:double,w:int,h:int>>, mask binary, fg binary, bg binary, w int, h int, space string"
)
RESULTS = f"job bigint, page int, mode string, key string, width double, height double, {OUTPUT}, error string"
ERROR_NO_RENDERER = "no renderer: pages that need rendering can't be masked"


def _mode_map(column: Any) -> dict[int, str]:
    return dict(column) if column else {}


def split_pages(jobs: DataFrame) -> DataFrame:
    """PAGES of (job, data, color_mode, overrides): one row a page, pages counted
    from 0; a document that fails gives one row with page -1 and its error.
    Pages to skip carry neither content nor document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from palimpsest.sources import pdf_pages as P
        from palimpsest.sources.pdf_syntax import read_document, write_document

        names = [x.split(" ")[0] for x in PAGES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.string()]
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                try:
                    doc = read_document(row["data"])
                    numbers = doc.pages()
                    modes = _mode_map(row["overrides"])
                    for page in modes:
                        if not 1 <= page <= len(numbers):
                            raise ValueError(f"page {page} is out of range: the document has {len(numbers)} pages")
                    for i, number in enumerate(numbers):
                        mode = modes.get(i + 1, row["color_mode"])
                        if mode == "skip":
                            rows.append((row["job"], i, mode, None, None, None, None, None))
                            continue
                        page = doc.objects[number]
                        w, h = P.page_size(doc, page)
                        writer = P.Writer()
                        writer.copy_page(doc, number)
                        rows.append((row["job"], i, mode, w, h, P.page_content(doc, page), write_document(writer.doc), None))
                except Exception as fault:  # noqa: BLE001  a bad document is a row, not a failed task
                    rows = [(row["job"], -1, None, None, None, None, None, f"{type(fault).__name__}: {fault}")]
                columns = list(zip(*rows, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return jobs.select("job", "data", "color_mode", "overrides").mapInArrow(run, PAGES)


def page_output(row: dict[str, Any], render) -> dict[str, Any]:
    """One page's output: outlines if its fonts allow, else the raster path."""
    from palimpsest.functions import compose
    from palimpsest.functions.truetype import FontFault
    from palimpsest.sources import fonts as fonts_of
    from palimpsest.sources import pdf_pages as P
    from palimpsest.sources.pdf_syntax import read_document

    doc = read_document(row["page_doc"])
    page = doc.objects[doc.pages()[0]]
    streams = P.image_streams(doc, page)
    why = "no fonts"
    try:
        fonts = fonts_of.page_fonts(doc, page)
        return compose.text_outlines(doc, row["content"], fonts, streams, row["mode"])
    except (FontFault, KeyError, ValueError) as fault:
        why = f"{type(fault).__name__}: {fault}"
    if render is None:
        raise RuntimeError(f"{ERROR_NO_RENDERER} ({why})")
    bitmap = render(row["page_doc"], 0, row["dpi"])
    return compose.from_bitmap(doc, row["content"], streams, bitmap, row["width"], row["height"], row["mode"], row)


def process_pages(pages: DataFrame, render=None) -> DataFrame:
    """RESULTS of pages (PAGES with key, dpi, bg_quality, fg_quality)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_spark_schema(RESULTS))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                out = dict.fromkeys(schema.names)
                out.update({k: row[k] for k in ("job", "page", "mode", "key", "width", "height")})
                try:
                    found = page_output(row, render)
                    images = [{"name": k, **v} for k, v in found.pop("images", {}).items()]
                    regions = []
                    for r in found.pop("regions", []):
                        x0, y0, x1, y1 = r["box"]
                        regions.append({"data": r["data"], "x0": x0, "y0": y0, "x1": x1, "y1": y1, "w": r["w"], "h": r["h"]})
                    out.update(found, images=images, regions=regions)
                except Exception as fault:  # noqa: BLE001  a bad page is a row
                    out["error"] = f"{type(fault).__name__}: {fault}"
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    return pages.mapInArrow(run, RESULTS)


def assemble(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(job, data, pages, error) of (job, data) and RESULTS: a document of all
    pages in order; a job with any failed page has its error and no data."""

    def run(left, right):
        import pyarrow as pa

        from palimpsest.sources import pdf_pages as P
        from palimpsest.sources.pdf_syntax import read_document, write_document

        source, rows = left.to_pylist(), sorted(right.to_pylist(), key=lambda r: r["page"])
        job = (source or rows)[0]["job"]
        data, error = None, next((r["error"] for r in rows if r["error"]), None)
        if error is None:
            try:
                doc = read_document(source[0]["data"])
                numbers = doc.pages()
                if len(rows) != len(numbers):
                    raise ValueError("pages are missing")
                writer = P.Writer()
                for r, number in zip(rows, numbers, strict=True):
                    if r["kind"] is None:
                        writer.copy_page(doc, number)
                    elif r["kind"] == "text_masked":
                        images = {i["name"]: i for i in r["images"]}
                        regions = [{**g, "box": (g["x0"], g["y0"], g["x1"], g["y1"])} for g in r["regions"]]
                        writer.text_masked(doc, number, {"content": r["content"], "images": images, "regions": regions})
                    elif r["kind"] == "bw_mask":
                        writer.bw(r, r["width"], r["height"])
                    else:
                        writer.layered(r, r["width"], r["height"])
                writer.optimize()
                data = write_document(writer.doc)
            except Exception as fault:  # noqa: BLE001
                error = f"{type(fault).__name__}: {fault}"
        return pa.table({"job": pa.array([job], pa.int64()), "data": pa.array([data], pa.binary()), "pages": pa.array([len(rows)], pa.int32()), "error": pa.array([error], pa.string())})

    grouped = jobs.select("job", "data").groupBy("job").cogroup(results.groupBy("job"))
    return grouped.applyInArrow(run, "job bigint, data binary, pages int, error string")


def skipped(pages: DataFrame) -> DataFrame:
    """RESULTS rows for pages that are copied, and for documents that failed."""
    held = pages.where((F.col("mode") == "skip") | F.col("error").isNotNull())
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in _spark_schema(RESULTS)}
    empty |= {c: F.col(c) for c in ("job", "page", "mode", "width", "height", "error")}
    return held.select(*[empty[f.name].alias(f.name) for f in _spark_schema(RESULTS)])


def _spark_schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
