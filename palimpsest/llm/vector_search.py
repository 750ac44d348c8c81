"""Approximate nearest neighbours by cross-polytope hashing.

A table hashes a unit vector to the signed axis nearest to its pseudo-rotation:
three rounds of random signs and a fast Hadamard transform (dimensions are padded
to a power of two). A bucket is one such axis, or the axes of several independent
pseudo-rotations (``parts``), as many as keep the mean bucket at half of
``group_rows`` rows or fewer. Every row is indexed: it lies in one bucket of each
table. A query probes, in each table, the ``probes`` buckets nearest to its own
rotations; rows of any probed bucket are candidates, all of them, and are ranked by
exact cosine in double precision.

Tables are searched one after another. The buckets of a table are dealt to groups of
about ``group_rows`` rows; rows travel to their bucket's group, a query once to each
group in which it probes a bucket, with the list of those buckets, and they meet
there: only candidates are compared. A group of more than ``group_rows`` rows is dealt
into as many cells, each visited by all of the group's queries; more than
``group_queries`` queries likewise. So a hot bucket is compared whole, in cells of
bounded size (both default to a number of components, ``CELL``), and a cell returns
each query's ``k`` best. No bucket is capped. Within a cell pairs are compared in
blocks, roughly in single precision, and those that may be among the best exactly; of
rows with the same vector the k + 1 first in order stand for all. Hashing, too, goes
by pieces, so a worker's memory depends neither on the probes nor on the table.

How many buckets are probed is measured: a sample of queries is compared exactly
with all rows, and ``probes`` becomes the least number by which the share ``recall``
of their nearest rows are candidates. If no number does (with several parts: none up
to ``MOST_PROBES``), ``parts`` is lowered; with one part all axes do. Queries that then
have fewer than ``k`` candidates, or fewer than ``least_share`` of what queries have in
the mean, are compared with all rows, in broadcast blocks of ``block`` vectors (a
bounded size).

Rows: vectors null, zero, or with null or non-finite components take no part.
Vectors of different lengths have no cosine: each length is a space of its own, with
its own index, and a query's candidates are the rows of its length (``dim`` keeps
one length only). Ties go to the smaller id, nulls last, then the row's number. Rows
that repeat or share an id are different candidates; a query excludes only its own
row. An empty table gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import common

#: Buckets of several parts that a query may probe in a table: it travels to each.
MOST_PROBES = 128
#: Components of the vectors of a cell's rows; of its queries half as many.
CELL = 1 << 22
#: Values that hashing holds in an array at once.
PIECE = 1 << 20


def hadamard(x):
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    import numpy as np

    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """``tables`` hash functions of ``parts`` rotations over vectors of dimension
    dim."""

    def __init__(self, dim: int, tables: int, parts: int = 1, seed: int = 11):
        import numpy as np

        self.width = 1 << max(0, (dim - 1).bit_length())
        self.dim, self.tables, self.parts = dim, tables, parts
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, parts, 3, self.width))

    def axes(self, x, table: int, part: int):
        """Closeness of each row to each signed axis: + axes, then - axes."""
        import numpy as np

        y = np.zeros((len(x), self.width))
        y[:, : self.dim] = x
        for s in self.signs[table, part]:
            y = hadamard(y * s)
        return np.concatenate([y, -y], axis=1)

    def buckets(self, x):
        """Bucket of each row in each table."""
        import numpy as np

        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for piece in _pieces(len(x), 2 * self.width):
            for t in range(self.tables):
                for part in range(self.parts):
                    out[piece, t] = out[piece, t] * (2 * self.width) + self.axes(x[piece], t, part).argmax(axis=1)
        return out

    def order(self, x, table: int, count: int):
        """The count buckets of a table nearest to each row, nearest first: those
        of least sum of squared distances behind the nearest axes."""
        import numpy as np

        wide = 2 * self.width
        each = max(wide, min(count, wide ** (self.parts - 1)) * min(count, wide))
        return np.concatenate([self._order(x[piece], table, count) for piece in _pieces(len(x), each)])

    def _order(self, x, table: int, count: int):
        import numpy as np

        bucket, behind = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
        for part in range(self.parts):
            close = self.axes(x, table, part)
            near = np.argsort(-close, axis=1, kind="stable")[:, :count]
            close = np.take_along_axis(close, near, axis=1)
            lag = (close[:, :1] - close) ** 2
            bucket = (bucket[:, :, None] * (2 * self.width) + near[:, None, :]).reshape(len(x), -1)
            behind = (behind[:, :, None] + lag[:, None, :]).reshape(len(x), -1)
            first = np.argsort(behind, axis=1, kind="stable")[:, :count]
            bucket, behind = np.take_along_axis(bucket, first, axis=1), np.take_along_axis(behind, first, axis=1)
        return bucket

    def ranks(self, x, wanted, count: int):
        """How many buckets x must probe, in the table where they are fewest, until
        wanted (its rows' buckets: queries x rows x tables) is found; count + 1
        where count don't do."""
        import numpy as np

        least = np.full(wanted.shape[:2], count + 1)
        for t in range(self.tables):
            near = self.order(x, t, count)
            for j in range(wanted.shape[1]):
                hit = near == wanted[:, j, t][:, None]
                np.minimum(least[:, j], np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, count + 1), out=least[:, j])
        return least


def _pieces(n: int, each: int) -> list[slice]:
    """Slices of n rows of each values, PIECE values at most or one row; at least one."""
    step = max(1, PIECE // each)
    return [slice(i, i + step) for i in range(0, max(n, 1), step)]


def unit(x):
    """Rows scaled to length 1, safely for very large or small ones."""
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, dim: int):
    """An Arrow list column of dim components a row as doubles."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: row, id, v (floats if the column has floats)."""
    kind = table.schema[vector_col].dataType
    element = "float" if getattr(kind, "elementType", None) == FloatType() else "double"
    rows = common.numbered(table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v")), "row")
    big = F.lit(float("inf"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))


def build_index(rows: DataFrame, dim: int, tables: int, parts: int) -> DataFrame:
    """rows with ``buckets``: one bucket a table, written to the shared folder."""
    common.small_batches(rows.sparkSession, 4096)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashing = CrossPolytope(dim, tables, parts)
        for batch in batches:
            found = hashing.buckets(unit(_matrix(batch.column(2), dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int64()))], names=["row", "id", "v", "buckets"])

    kind = rows.schema["v"].dataType.simpleString()
    return common.stage_table(rows.select("row", "id", "v").mapInArrow(run, f"row bigint, id bigint, v {kind}, buckets array<bigint>"), "index")


def choose(rows: DataFrame, queries: DataFrame, n: int, n_queries: int, dim: int, tables: int, k: int, recall: float, group_rows: int) -> tuple[int, int]:
    """(parts, probes): the most parts that the table's size asks for by which some
    number of probes finds the share recall of the k nearest rows of a sample of
    queries, and the least such number."""
    import numpy as np

    width = 2 * CrossPolytope(dim, 1).width
    if n <= k + 1 or not n_queries:
        return 1, width
    parts = max(1, math.ceil(math.log(max(1.0, 2 * n / group_rows)) / math.log(width)))
    asked = queries.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n_queries // 256))) == 0).select("row", "id", "v").collect()
    if not asked:
        return 1, width
    shared = rows.sparkSession.sparkContext.broadcast([(r.row, r.id, list(r.v)) for r in asked])
    near = ranked(common.stage_table(_search_block(rows, shared, dim, k), "sample"), k, 1).select("query_row", "row")
    # the sample's rows are few, whatever the table's size
    pairs = rows.select("row", "v").join(F.broadcast(common.stage_table(near, "nearest")), "row").select("query_row", "v").toArrow().combine_chunks()
    place = {r.row: i for i, r in enumerate(asked)}
    at = np.array([place[x] for x in pairs.column("query_row").to_pylist()], dtype=np.int64)
    q = unit(np.array([r.v for r in asked], dtype=np.float64).reshape(-1, dim))
    v = unit(_matrix(pairs.column("v").combine_chunks(), dim))[np.argsort(at, kind="stable")]
    for count in range(parts, 0, -1):
        hashing = CrossPolytope(dim, tables, count)
        most = min(width**count, MOST_PROBES) if count > 1 else width
        needed = np.sort(hashing.ranks(q, hashing.buckets(v).reshape(len(q), k, tables), most).ravel())
        probes = int(needed[int(np.ceil(recall * len(needed))) - 1])
        if probes <= most:
            return count, probes
    return 1, width


#: Best rows of a query within a cell; seen stands in one of them.
FOUND = "query_row bigint, query_id bigint, row bigint, id bigint, score double, seen bigint"


def _first_copies(v, most: int):
    """Rows that stay when of equal vectors the most first do."""
    import numpy as np

    word = np.ascontiguousarray(v).view(np.uint64)
    h = (word * np.random.default_rng(3).integers(1, 2**64, word.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    stays = np.ones(len(v), dtype=bool)
    _, start, count = np.unique(h[by := np.argsort(h, kind="stable")], return_index=True, return_counts=True)
    for a, n in zip(start[count > most].tolist(), count[count > most].tolist(), strict=True):
        if all((word[by[i : i + 4096]] == word[by[a]]).all() for i in range(a, a + n, 4096)):
            stays[by[a + most : a + n]] = False
    return np.flatnonzero(stays)


def _firsts(a, b, score, k: int):
    """The k best b of each a, ties to the smaller b; by a, best first."""
    import numpy as np

    order = np.lexsort((b, -score, a))
    a, b, score = a[order], b[order], score[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    return a[nth < k], b[nth < k], score[nth < k]


def _compared(q, v, own_at, k: int, tall: int = 256, wide: int = 4096, pairs: int = 1 << 15):
    """(query, row, score) of each query's k best rows but the one at own_at, ties to
    the first."""
    import numpy as np

    slack = (q.shape[1] + 3) * 2.0**-24  # of a rough score
    rough_q, rough_v = q.astype(np.float32), v.astype(np.float32)
    out = []
    for i in range(0, len(q), tall):
        own = own_at[i : i + tall]
        floor = np.full(len(own), -2.0)
        best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for j in range(0, len(v), wide):
            rough = rough_q[i : i + tall] @ rough_v[j : j + wide].T
            here = np.flatnonzero((own >= j) & (own < j + wide))
            rough[here, own[here] - j] = -np.inf
            if j == 0 and rough.shape[1] > k:
                floor = np.maximum(np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k].astype(np.float64) - slack, -2.0)
            a, b = np.divmod(np.flatnonzero(rough >= (floor - slack).astype(np.float32)[:, None]), rough.shape[1])
            if not len(a):
                continue
            b += j
            # pair by pair, so equal vectors have equal scores wherever they lie
            exact = np.concatenate([(q[i + a[p : p + pairs]] * v[b[p : p + pairs]]).sum(axis=1) for p in range(0, len(a), pairs)])
            best = _firsts(*(np.concatenate(x) for x in zip(best, (a, b, exact), strict=True)), k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(own)) == k)
            floor[full] = best[2][np.searchsorted(best[0], full, side="right") - 1]
        out.append((best[0] + i, *best[1:]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best(own, qid, q, rows, ids, v, k: int, asked=None, lying=None):
    """Each query's k best of the rows, its own left out: an Arrow table FOUND. Given
    asked (pairs of a query and a bucket that it probes) and lying (the rows' buckets),
    of the rows in its buckets."""
    import numpy as np
    import pyarrow as pa

    none = np.array([x is None for x in ids], dtype=bool)
    number = np.array([0 if x is None else x for x in ids], dtype=np.int64)
    # rows in the order in which ties go to them
    order = np.lexsort((rows, number, none))
    whose = np.searchsorted(rows, own, sorter=(by := np.argsort(rows)))
    at = by[np.minimum(whose, len(rows) - 1)]
    at = np.where(rows[at] == own, np.argsort(order)[at], -1)
    rows, v = rows[order], v[order]
    seen = np.zeros(len(own), dtype=np.int64)
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    if asked is None:
        meetings = [(np.arange(len(own)), np.arange(len(rows)))]
    else:
        lying = lying[order]
        by_bucket, by_asked = np.argsort(lying, kind="stable"), np.argsort(asked[1], kind="stable")
        buckets, ends = lying[by_bucket], asked[1][by_asked]
        meetings = (
            (asked[0][by_asked[np.searchsorted(ends, b) : np.searchsorted(ends, b, side="right")]], by_bucket[np.searchsorted(buckets, b) : np.searchsorted(buckets, b, side="right")])
            for b in np.intersect1d(buckets, ends)
        )
    for some, those in meetings:
        mine = np.searchsorted(those, at[some])
        has = (at[some] >= 0) & (those[np.minimum(mine, len(those) - 1)] == at[some])
        seen[some] += len(those) - has
        stay = _first_copies(v[those], k + 1)
        place = np.searchsorted(stay, mine)
        has &= stay[np.minimum(place, len(stay) - 1)] == mine
        a, b, score = _compared(q[some], v[those[stay]], np.where(has, place, -1), k)
        found.append((some[a], those[stay[b]], score))
    a, b, score = _firsts(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    ids = pa.array([ids[i] for i in order[b]], pa.int64())
    return pa.table(
        [pa.array(own[a], pa.int64()), pa.array([qid[i] for i in a], pa.int64()), pa.array(rows[b], pa.int64()), ids, pa.array(score), pa.array(np.where(nth == 0, seen[a], 0), pa.int64())],
        names=["query_row", "query_id", "row", "id", "score", "seen"],
    )


def probed(queries: DataFrame, dim: int, tables: int, parts: int, table: int, probes: int, groups: int) -> DataFrame:
    """(group, buckets, row, id, v) of every group in which a query probes buckets of
    the table."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hashing = CrossPolytope(dim, tables, parts)
        for batch in batches:
            step = max(1, min(CELL // 4 // dim // min(probes, groups), PIECE // probes))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                near = hashing.order(unit(_matrix(part.column(2), dim)), table, probes)
                who = np.repeat(np.arange(len(near)), near.shape[1])
                group, near = _group(near.ravel(), groups), near.ravel()
                order = np.lexsort((near, group, who))
                who, group, near = who[order], group[order], near[order]
                start = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (group[1:] != group[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(near)), pa.int32()), pa.array(near))
                yield pa.RecordBatch.from_arrays([pa.array(group[start]), lists, *(c.take(pa.array(who[start])) for c in part.columns)], names=["group", "buckets", "row", "id", "v"])

    kind = queries.schema["v"].dataType.simpleString()
    return queries.select("row", "id", "v").mapInArrow(run, f"group bigint, buckets array<bigint>, row bigint, id bigint, v {kind}")


def _group(bucket, groups: int):
    """Group of each bucket, an array or a Column: neighbouring numbers lie apart."""
    return bucket * 7919 % groups


def search(index: DataFrame, queries: DataFrame, dim: int, tables: int, parts: int, table: int, probes: int, k: int, count: int, group_rows: int, group_queries: int) -> DataFrame:
    """FOUND of every cell of one table, written."""
    groups = min((2 * CrossPolytope(dim, 1).width) ** parts, max(1, -(-count // group_rows)))
    bucket = F.col("buckets")[table]
    rows = index.select(_group(bucket, groups).alias("group"), bucket.alias("bucket"), "row", "id", "v")
    asked = common.stage_table(probed(queries, dim, tables, parts, table, probes, groups), "probes")
    # cells of the groups that need more than one
    sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("across"))
    visits = asked.groupBy("group").agg(F.ceil(F.count("*") / group_queries).cast("int").alias("down"))
    hot = common.stage_table(visits.join(sizes, "group").where("across > 1 or down > 1"), "cells")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        columns = side.columns[1:]
        side = side.join(hot, "group", "left")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)).alias(f"{other}_cell")
        mine = F.pmod(F.xxhash64("row"), F.coalesce(F.col(own), F.lit(1))).cast("int").alias(f"{own}_cell")
        return side.select("group", mine, every, *columns)

    cell = ["group", "across_cell", "down_cell"]

    def meet(left, right):
        import numpy as np
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(("query_row", "query_id", "row", "id", "score", "seen"), [pa.int64()] * 4 + [pa.float64(), pa.int64()], strict=True)})
        q, v = (unit(_matrix(side.column("v").combine_chunks(), dim)) for side in (left, right))
        lists = left.column("buckets").combine_chunks()
        asked = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        return _best(left.column("row").to_numpy(), left.column("id").to_pylist(), q, right.column("row").to_numpy(), right.column("id").to_pylist(), v, k, asked, right.column("bucket").to_numpy())

    visiting, lying = dealt(asked, "down", "across"), dealt(rows, "across", "down")
    found = common.stage_table(visiting.groupBy(*cell).cogroup(lying.groupBy(*cell)).applyInArrow(meet, FOUND), "found")
    common.drop_table(asked)
    return found


def search_all(index: DataFrame, queries: DataFrame, dim: int, k: int, block: int) -> DataFrame:
    """FOUND of every query among all rows, by blocks of queries, each broadcast."""
    count = queries.count()
    parts = max(1, -(-count // block))
    out = None
    for p in range(parts):
        part = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == p)
        shared = index.sparkSession.sparkContext.broadcast([(r.row, r.id, list(r.v)) for r in part.select("row", "id", "v").collect()])
        found = common.stage_table(_search_block(index, shared, dim, k), "found")
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(index: DataFrame, shared, dim: int, k: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        asked = shared.value
        if not asked:
            return
        own, qid = np.array([a[0] for a in asked]), [a[1] for a in asked]
        q = unit(np.array([a[2] for a in asked], dtype=np.float64).reshape(-1, dim))
        held: list = []
        for batch in chain(batches, [None]):
            held += [batch] if batch is not None and batch.num_rows else []
            if held and (batch is None or sum(b.num_rows for b in held) * dim >= CELL):
                rows = pa.Table.from_batches(held).combine_chunks()
                held = []
                vectors = unit(_matrix(rows.column(2).combine_chunks(), dim))
                yield from _best(own, qid, q, rows.column(0).to_numpy(), rows.column(1).to_pylist(), vectors, k).to_batches()

    common.small_batches(index.sparkSession, 4096)
    return index.select("row", "id", "v").mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int, copies: int) -> DataFrame:
    """query_row, query_id, rank, row, id, score: the k best of what was found, where
    a row may have been found copies times."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    best = found.withColumn("rank", place).where(F.col("rank") <= k * copies)
    best = best.groupBy("query_row", "row").agg(F.first("query_id").alias("query_id"), F.first("id").alias("id"), F.first("score").alias("score"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "row", "id", "score")


def nearest(
    table: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
    tables: int = 4, probes: int | None = None, block: int = 2048, dim: int | None = None,
    recall: float = 0.99, least_share: float = 0.1, group_rows: int | None = None, group_queries: int | None = None,
) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest found of every row for
    which the condition is_query (a Column over ``id``) holds. probes None: as
    many as the measured recall needs."""
    valid = common.stage_table(valid_vectors(table, id_col, vector_col), "vectors")
    sizes = valid.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.count(F.when(is_query, 1)).alias("queries")).collect()
    out = None
    lengths = sorted(tuple(r) for r in sizes if dim in (None, r.n) and r.queries)
    for n, count, asking in lengths:
        rows = valid.where(F.size("v") == n)
        most_rows, most_queries = group_rows or max(1, CELL // n), group_queries or max(1, CELL // 2 // n)
        parts, enough = choose(rows, rows.where(is_query), count, asking, n, tables, k, recall, most_rows)
        index = build_index(rows, n, tables, parts)
        if n == lengths[-1][0]:
            common.drop_table(valid)
        queries = index.where(is_query)
        best = seen = None
        for t in range(tables):
            found = search(index, queries, n, tables, parts, t, enough if probes is None else probes, k, count, most_rows, most_queries)
            some = common.stage_table(ranked(found, k, 1), "best")
            saw = common.stage_table(found.groupBy("query_row").agg(F.sum("seen").alias("seen")), "seen")
            common.drop_table(found)
            best, seen = (some, saw) if best is None else (best.unionByName(some), seen.unionByName(saw))
        best = common.stage_table(ranked(best, k, tables), "best")
        seen = seen.groupBy("query_row").agg(F.sum("seen").alias("seen"))
        mean = (seen.agg(F.sum("seen")).first()[0] or 0) / asking
        served = best.groupBy("query_row").count().join(seen, "query_row")
        served = served.where((F.col("count") >= k) & (F.col("seen") >= F.lit(least_share * mean))).select("query_row")
        short = common.stage_table(queries.join(served, queries.row == served.query_row, "left_anti").select("row", "id", "v"), "short")
        if not short.isEmpty():
            best = best.join(served, "query_row", "left_semi").unionByName(ranked(search_all(index, short, n, k, block), k, 1))
        out = best if out is None else out.unionByName(best)
    if out is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    return out.select("query_id", "rank", "id", "score")
