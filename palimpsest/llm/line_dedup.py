"""Line dedup by content-defined chunks of lines.

``dedup`` removes chunks, as its SQL states; ``dedup_runs`` removes them and grows
what they find, so that every repeated run of at least two lines goes.

A line's hash is the first 32 bits of its MD5. A rolling hash over the hashes of
the last two lines ends a chunk where it is divisible by ``divisor``, so
boundaries depend on nearby lines alone and a passage has the same ones wherever
it stands. Chunks of at least ``least_lines`` lines that occur more than once in
the corpus, the same document included, stay where they come first (least doc_id,
nulls last, then row, then place) and are removed elsewhere, after their bytes
have been compared with those of the first.

Only chunk hashes are shuffled to find what repeats; then the repeated chunks'
bytes alone are gathered for the comparison. Counts are combined before the
shuffle, and the comparison is a join whose hot keys Spark may split, so a chunk
that a third of all documents hold needs no task of its own.

Runs: repeated chunks are the seeds, found and compared as above. An exact step then
settles the lines around them, and runs too short to hold a chunk: a run of two lines
or more that occurs before is one whose every pair of neighbouring lines occurs
before. The pairs within a chunk removed are settled by it, and the first of none of
their kinds, so only the others, a chunk's borders among them, are compared, by the
SHA-256 of their bytes. Both lines of each pair but the first of its kind go. A pair
of equal lines that overlaps the first of its kind is not another one. The first
place of any line is in no later pair, so no line is lost from the corpus.

Rows: a null text stays null and has no lines; an empty text is one empty line. A
text whose every line goes becomes empty. Rows that repeat or share an id are
separate documents: the first keeps its chunks. An empty table gives no rows. A
very long text costs time in proportion to its length: what goes are sorted spans,
and the lines between them are copied once. Only ``doc_id`` and ``text`` are read;
all other columns, of any name, pass through, but for any called ``_n_lines`` or
``_n_removed`` (in whatever case), in whose place the counts stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def chunks(lines: list[bytes], divisor: int) -> list[tuple[int, int]]:
    """(first, past last) line of each chunk."""
    out, start, before = [], 0, None
    for i, line in enumerate(lines):
        h = int(hashlib.md5(line).hexdigest()[:8], 16)
        if before is not None and (before * 31 + h) % divisor == 0:
            out.append((start, i + 1))
            start = i + 1
        before = h
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def chunk_rows(base: DataFrame, divisor: int, least_lines: int) -> DataFrame:
    """(whole, row, id, at, to) of every chunk of enough lines; whole is the MD5
    of its bytes, at and to its lines."""
    common.small_batches(base.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.text_bytes(batch.column(2)), strict=True):
                if text is None:
                    continue
                lines = text.split(b"\n")
                for a, b in chunks(lines, divisor) if len(lines) >= least_lines else ():
                    if b - a >= least_lines:
                        for column, x in zip(out, (hashlib.md5(b"\n".join(lines[a:b])).digest(), row, doc_id, a, b), strict=True):
                            column.append(x)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["whole", "row", "id", "at", "to"])

    chosen = base.select("_row", F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "whole binary, row bigint, id bigint, at int, to int")


def _chunk_bytes(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(whole, row, at, to, first, data) of the wanted chunks."""
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("whole", "at", "to", "first")).alias("parts"))
    texts = base.select(F.col("_row").alias("row"), F.col("text").cast("string").alias("text"))
    texts = texts.join(by_row.hint("merge"), "row").select("row", "text", "parts.whole", "parts.at", "parts.to", "parts.first")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            columns = [batch.column(0).to_pylist(), common.text_bytes(batch.column(1)), *(batch.column(i).to_pylist() for i in range(2, 6))]
            for row, text, *parts in zip(*columns, strict=True):
                lines = text.split(b"\n")
                for whole, at, to, first in zip(*parts, strict=True):
                    for column, x in zip(out, (whole, row, at, to, first, b"\n".join(lines[at:to])), strict=True):
                        column.append(x)
                    held += len(out[5][-1])
                if held > 32 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["whole", "row", "at", "to", "first", "data"])
                    out, held = [[], [], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["whole", "row", "at", "to", "first", "data"])

    return texts.mapInArrow(run, "whole binary, row bigint, at int, to int, first boolean, data binary")


def repeated(base: DataFrame, divisor: int, least_lines: int) -> DataFrame:
    """(row, at, to) of the chunks to remove."""
    found = common.stage_table(chunk_rows(base, divisor, least_lines), "chunks")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "at")
    shared = found.groupBy("whole").agg(F.count("*").alias("n"), F.min(order).alias("least")).where("n > 1")
    shared = common.stage_table(shared, "repeated")  # so that the join may split a hot chunk
    marked = found.join(shared, "whole").withColumn("first", (F.col("row") == F.col("least.row")) & (F.col("at") == F.col("least.at")))
    held = common.stage_table(_chunk_bytes(base, marked.select("whole", "row", "at", "to", "first")), "shared")
    first = held.where("first").select("whole", F.col("data").alias("first_data"))
    spare = held.where("not first").join(first, "whole").where(F.col("data") == F.col("first_data"))
    return common.stage_table(spare.select("row", "at", "to"), "spare")


ADDED = ("_n_lines", "_n_removed")


def _carried(docs: DataFrame) -> DataFrame:
    """Numbered rows of doc_id, text and ``doc``, all of docs' columns, so that no
    name of theirs meets one used here."""
    return common.numbered(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct("*").alias("doc")))


def _without(base: DataFrame, spans: DataFrame) -> DataFrame:
    """base's ``doc`` columns, text without the spans (row, spans: sorted, disjoint
    array of (at, to) lines), and ADDED."""
    names = base.schema["doc"].dataType.names
    # merged at every size: what is removed grows with the corpus
    joined = base.join(spans.select(F.col("row").alias("_row"), F.col("spans.at").alias("_from"), F.col("spans.to").alias("_past")).hint("merge"), "_row", "left")
    lines = F.split("text", "\n", -1)
    joined = joined.withColumns(
        {
            ADDED[0]: F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint"),
            ADDED[1]: F.coalesce(F.aggregate(F.arrays_zip("_from", "_past"), F.lit(0), lambda s, g: s + g["_past"] - g["_from"]), F.lit(0)).cast("bigint"),
            "_lines": F.when(F.col("_from").isNotNull(), lines),
        }
    )
    between = F.arrays_zip(F.concat(F.array(F.lit(0)), "_past").alias("a"), F.concat("_from", F.array(F.size("_lines"))).alias("b"))
    stays = F.flatten(F.transform(between, lambda g: F.slice("_lines", g["a"] + 1, g["b"] - g["a"])))
    text = F.when(F.col("_from").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    kept = [text.alias(c) if c.lower() == "text" else F.col("doc").getField(c).alias(c) for c in names if c.lower() not in ADDED]
    return joined.select(*kept, *ADDED)


def dedup(docs: DataFrame, divisor: int = 3, least_lines: int = 2) -> DataFrame:
    """docs, its text without the repeated chunks; ``_n_lines`` and ``_n_removed``
    are added."""
    base = _carried(docs)
    gone = repeated(base, divisor, least_lines).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("spans"))
    return _without(base, gone)


def pair_rows(base: DataFrame, seeds: DataFrame) -> DataFrame:
    """(whole, row, id, at) of every two neighbouring lines that no seed (row, spans:
    sorted, disjoint array of (at, to) lines) holds both; whole is the SHA-256 of
    their bytes, at the first one's place."""
    common.small_batches(base.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], []]
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.text_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()]
            for row, doc_id, text, starts, pasts in zip(*columns, strict=True):
                lines = text.split(b"\n") if text is not None else []
                # from each seed's last line to the next one's first
                for a, b in zip([0, *(p - 1 for p in pasts or ())], [*(starts or ()), len(lines) - 1], strict=True):
                    n = b - a
                    if n < 1:
                        continue
                    out[0] += [hashlib.sha256(x + b"\n" + y).digest() for x, y in zip(lines[a:b], lines[a + 1 : b + 1], strict=True)]
                    out[1] += [row] * n
                    out[2] += [doc_id] * n
                    out[3] += range(a, b)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["whole", "row", "id", "at"])

    chosen = base.select("_row", F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    # merged at every size: what is removed grows with the corpus
    seeds = seeds.select(F.col("row").alias("_row"), F.col("spans.at").alias("_from"), F.col("spans.to").alias("_past")).hint("merge")
    return chosen.join(seeds, "_row", "left").mapInArrow(run, "whole binary, row bigint, id bigint, at int")


def repeated_pairs(base: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, at) of the pairs of lines outside the seeds to remove."""
    found = common.stage_table(pair_rows(base, seeds), "pairs")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "at")
    shared = found.groupBy("whole").agg(F.count("*").alias("n"), F.min(order).alias("least")).where("n > 1")
    shared = common.stage_table(shared, "repeated")  # so that the join may split a hot pair
    own = (F.col("row") == F.col("least.row")) & (F.col("at") <= F.col("least.at") + 1)
    return common.stage_table(found.join(shared, "whole").where(~own).select("row", "at"), "spare")


def dedup_runs(docs: DataFrame, divisor: int = 3, least_lines: int = 2) -> DataFrame:
    """docs, its text without the repeated runs of two lines or more; ``_n_lines``
    and ``_n_removed`` are added."""
    base = _carried(docs)
    chunks_gone = repeated(base, divisor, max(2, least_lines))
    seeds = chunks_gone.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("spans"))
    inside = chunks_gone.select("row", F.explode(F.sequence("at", F.col("to") - 2)).alias("at"))
    gone = repeated_pairs(base, seeds).unionByName(inside).groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("_at"))
    # pairs that follow one another are one run
    starts = F.filter("_at", lambda x, i: (i == 0) | (F.get("_at", i - 1) < x - 1))
    past = F.transform(F.filter("_at", lambda x, i: (i == F.size("_at") - 1) | (F.get("_at", i + 1) > x + 1)), lambda x: x + 2)
    return _without(base, gone.select("row", F.arrays_zip(starts.alias("at"), past.alias("to")).alias("spans")))


#: ``dedup`` by DuckDB, on a table of unique ids.
SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
e AS (
  SELECT *, coalesce((lag(h) OVER (PARTITION BY doc_id ORDER BY i) * 31 + h) % 3 = 0, false) AS ends FROM h
), c AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e
), g AS (
  SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body, min(i) AS first_line FROM c GROUP BY ALL
), r AS (
  SELECT doc_id, chunk, row_number() OVER (PARTITION BY body ORDER BY doc_id, first_line) > 1 AS spare FROM g WHERE n >= 2
), k AS (
  SELECT c.doc_id, c.i, c.line, coalesce(r.spare, false) AS spare FROM c LEFT JOIN r USING (doc_id, chunk)
), s AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE spare) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT spare), '') AS body
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(s.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(s.body, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""
