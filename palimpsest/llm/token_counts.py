"""Token counts of documents in flat, unindexed token files.

A token file is nothing but little-endian ids (16 or 32 bits), documents ended by
a separator id. ``count_tokens`` finds the documents again: a file is read in
blocks of ``block_tokens``, a vectorised comparison finds the separators of each
block, and an exclusive prefix scan over the blocks of a file (documents begun,
last separator so far) stitches documents that straddle blocks. Blocks are read
by range, so memory is bounded by a block whatever a file's size. What the blocks
hold is written; the scan sees three numbers a block, first summed over spans of
``span_blocks`` blocks, so the one task of a file has a row a span, and meets the
blocks again in a join.

Files are written and read through ``pyarrow.fs``, which opens the shared folder
by its URI; a shard is written under a temporary name and moved into place, so a
task that runs again replaces its shard whole.

Rows: a null text is empty: no tokens, one separator. Rows that repeat, share an
id or have none are counted each by itself. An empty table, and empty files, give
no rows; ids after the last separator give a row that is not ``terminated``. A very
long text is one document over as many blocks as it takes. An id that the width
can't hold is an error. Only ``doc_id`` and ``text`` are read, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":/", ":///", 1))


def write_token_files(docs: DataFrame, folder: str, separator: int = 50256, width: int = 2, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Write one flat token file a partition; return the written list of
    (file, doc_number, doc_id), the only record of which document is where."""
    files = vocabulary or tokens.vocabulary_files()
    if separator >> (8 * width):
        raise ValueError(f"separator {separator} does not fit {width} bytes")
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc = tokens.encoder(*files, plain_special=True)
        part = TaskContext.get()
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name = f"shard-{part.partitionId():06d}.bin"
        draft = f"{root}/_{name}.{part.taskAttemptId()}"
        end = np.array([separator], dtype=f"<u{width}")
        n = 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                ids = enc.ids([t or "" for t in batch.column(1).to_pylist()])
                flat = np.concatenate([x for y in ids for x in (y, end)] or [end[:0]])
                if len(flat) and int(flat.max()) >> (8 * width):
                    raise ValueError(f"token id {flat.max()} does not fit {width} bytes")
                out.write(flat.astype(end.dtype).tobytes())
                numbers = pa.array(range(n, n + batch.num_rows), pa.int64())
                n += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), numbers, batch.column(0)], names=["file", "doc_number", "doc_id"])
        store.move(draft, f"{root}/{name}")

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.stage_table(chosen.mapInArrow(run, "file string, doc_number bigint, doc_id bigint"), "token-list")


def count_tokens(spark: SparkSession, folder: str, separator: int = 50256, width: int = 2, block_tokens: int = 1 << 22, span_blocks: int = 1024) -> DataFrame:
    """Per document of the token files in folder: file, doc_number (from 0),
    start (its first id's place in the file), n_tokens, terminated."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = [(s.getPath().getName(), s.getLen() // width) for s in store.listStatus(path) if s.isFile()] if store.exists(path) else []
    listed = [x for x in listed if x[0][0] not in "_."]
    sizes = spark.createDataFrame(listed, "file string, size bigint")
    step = F.lit(block_tokens).cast("bigint")
    blocks = sizes.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, step)).alias("at"))
    blocks = blocks.repartition(max(1, min(10_000, sum(-(-n // block_tokens) for _, n in listed))))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        fs, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as f:
                    count = min(block_tokens, row["size"] - row["at"])
                    ids = np.frombuffer(f.read_at(count * width, row["at"] * width), dtype=f"<u{width}")
                ends = np.flatnonzero(ids == separator) + row["at"]
                arrays = [pa.array([row[k]]) for k in ("file", "size", "at")] + [pa.array([ends], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "size", "at", "ends"])

    found = common.stage_table(blocks.mapInArrow(run, "file string, size bigint, at bigint, ends array<bigint>"), "separators")
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    span = F.floor(F.col("at") / (block_tokens * span_blocks)).alias("span")
    brief = found.select("file", "at", span, F.size("ends").cast("bigint").alias("count"), last.alias("last"))

    def scan(rows: DataFrame, within: list[str], order: str) -> DataFrame:
        before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begun"), F.max("last").over(before).alias("last_end"))

    spans = scan(brief.groupBy("file", "span").agg(F.sum("count").alias("count"), F.max("last").alias("last")), ["file"], "span")
    within = scan(brief, ["file", "span"], "at").join(spans.select("file", "span", F.col("begun").alias("span_begun"), F.col("last_end").alias("span_end")), ["file", "span"])
    places = within.select("file", "at", (F.col("begun") + F.col("span_begun")).alias("begun"), F.coalesce("last_end", "span_end", F.lit(-1)).alias("last_end"))
    scanned = found.join(places, ["file", "at"])
    # ids after the last separator end, unterminated, where the file ends
    last_block = F.col("at") + block_tokens >= F.col("size")
    final = F.coalesce(last, F.col("last_end"))
    scanned = scanned.withColumn("all_ends", F.when(last_block & (final < F.col("size") - 1), F.concat("ends", F.array("size"))).otherwise(F.col("ends")))
    each = scanned.select("file", "size", "begun", "last_end", "all_ends", F.posexplode("all_ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("last_end")).otherwise(F.col("all_ends")[F.col("k") - 1]) + 1
    return each.select("file", (F.col("begun") + F.col("k")).alias("doc_number"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("end") < F.col("size")).alias("terminated"))


def document_token_counts(docs: DataFrame, separator: int = 50256, block_tokens: int = 1 << 22) -> DataFrame:
    """Write docs as token files, scan them, and name each document again."""
    spark = docs.sparkSession
    folder = common.new_path(spark, "token-files")
    names = write_token_files(docs, folder, separator)
    return count_tokens(spark, folder, separator, block_tokens=block_tokens).join(names.hint("merge"), ["file", "doc_number"])
