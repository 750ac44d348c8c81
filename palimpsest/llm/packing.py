"""Vector best-fit packing of token pieces into sequences.

Every sequence has three capacities: tokens, documents and attention cost (the
sum of squared piece lengths, what block-diagonal attention costs). A piece goes
to the open sequence, feasible under all three, with the smallest weighted
residual norm or the largest weighted dot product of its sizes and the
residuals; if none is feasible a sequence is opened.

Pieces are dealt into groups of about ``group_rows`` by a hash of their row
number in a written table, so a group has about the same mix of lengths as the
whole and costs at most one part-filled sequence more than packing in one place;
no group grows with the input or with any key.

Rows: a null text is empty and gives one piece of one id (the separator). Rows
that repeat, share an id or have none are packed each by itself. An empty table
gives no rows. A very long text is cut into as many pieces as it takes; ties go to
the earlier row and the earlier bin. Only ``doc_id`` and ``text`` are read, so other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(
    docs: DataFrame, capacity: int = 2048, separator: int = 0, vocabulary: tuple[str, str] | None = None, keep_ids: bool = False
) -> DataFrame:
    """Token pieces of whole texts: PIECES, and ``ids`` (array) with keep_ids."""
    files = vocabulary or tokens.vocabulary_files()
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        enc = tokens.encoder(*files)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.ids(texts), strict=True):
                ids = np.append(ids, np.uint32(separator)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + n]
                    values = (doc_id, k, start, n, zlib.crc32(part.tobytes()), part if keep_ids else None)
                    for name, value in zip(rows, values, strict=True):
                        rows[name].append(value)
            arrays = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32())]
            arrays += [pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
            names = list(rows)[:5]
            if keep_ids:
                arrays.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


def best_fit(lengths, capacity: int, max_docs: int, max_cost: int, weights=(1.0, 1e-3, 1e-3), rule: str = "norm"):
    """Bin and offset of each length, longest first; ties: the earliest bin.

    Residuals are taken as shares of their capacities, so weights compare.
    A piece that alone breaks a capacity is an error.
    """
    import numpy as np

    lengths = np.asarray(lengths, dtype=np.int64)
    n = len(lengths)
    if n and (lengths.max() > capacity or (lengths**2).max() > max_cost or max_docs < 1):
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    order = np.argsort(-lengths, kind="stable")
    res = np.zeros((n, 3))
    limit = np.array([capacity, max_docs, max_cost], dtype=float)
    w = np.asarray(weights) / 1.0
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    used = low = 0
    smallest = lengths.min() if n else 0
    for i in order:
        need = np.array([lengths[i], 1, lengths[i] ** 2], dtype=float)
        choice = -1
        if used > low:
            view = res[low:used]
            ok = (view >= need).all(axis=1)
            if ok.any():
                left = (view - need) / limit
                score = (w * left * left).sum(axis=1) if rule == "norm" else -(w * (need / limit) * (view / limit)).sum(axis=1)
                choice = low + int(np.where(ok, score, np.inf).argmin())
        if choice < 0:
            choice = used
            res[used] = limit
            used += 1
        bins[i] = choice
        offsets[i] = capacity - int(res[choice, 0])
        res[choice] -= need
        while low < used and (res[low, 0] < smallest or res[low, 1] < 1):
            low += 1  # nothing fits there any more
    return bins, offsets


def pack(
    piece_rows: DataFrame,
    capacity: int = 2048,
    max_docs: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    rule: str = "norm",
    group_rows: int = 16_384,
) -> DataFrame:
    """piece_rows with ``sequence_id`` and ``offset``. piece_rows must come from a
    written table: row numbers deal the groups. By default the document and cost
    capacities are those that the token capacity implies."""
    max_docs, max_cost = max_docs or capacity, max_cost or capacity * capacity
    spark = piece_rows.sparkSession
    groups = common.spread_partitions(spark, piece_rows.count(), group_rows)

    def run(table):
        import numpy as np
        import pyarrow as pa

        g = table.column("_group")[0].as_py()
        table = table.sort_by([("length", "descending"), ("_row", "ascending")])
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity, max_docs, max_cost, weights, rule)
        table = table.drop_columns(["_group", "_row"])
        table = table.append_column("sequence_id", pa.array(bins + (np.int64(g) << 32)))
        return table.append_column("offset", pa.array(offsets))

    dealt = piece_rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in piece_rows.schema)
    return dealt.groupBy("_group").applyInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def staged_pieces(docs: DataFrame, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """The pieces of whole documents as a written table, as ``pack`` needs them."""
    return common.stage_table(pieces(docs, capacity, keep_ids=keep_ids), "pieces")


def pack_documents(docs: DataFrame, capacity: int = 2048, keep_ids: bool = False, **limits) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row a piece."""
    return pack(staged_pieces(docs, capacity, keep_ids), capacity, **limits)
