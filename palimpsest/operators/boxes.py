"""Joins and merges of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import geometry


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, cell: float, how: str = "inner") -> DataFrame:
    """Pairs of one key whose boxes a and b overlap.

    Boxes are dealt to the grid cells they touch, so the join is an equi join on
    (keys, cell) with the overlap as residual, never a product; a pair is kept in
    the one cell that holds the low corner of its intersection. ``how`` may be
    inner, left_semi or left_anti; left rows need a column ``_id`` for those.
    """
    grid = lambda df, c: df.withColumn("_cx", F.explode(_cells(F.col(c)["x_min"], F.col(c)["x_max"], cell))).withColumn(
        "_cy", F.explode(_cells(F.col(c)["y_min"], F.col(c)["y_max"], cell))
    )
    on = [*keys, "_cx", "_cy"]
    fits = geometry.overlaps(F.col(a), F.col(b))
    pairs = grid(left, a).join(grid(right, b), on).where(fits)
    corner = lambda axis: F.floor(F.greatest(F.col(a)[f"{axis}_min"], F.col(b)[f"{axis}_min"]) / cell)
    pairs = pairs.where((corner("x") == F.col("_cx")) & (corner("y") == F.col("_cy"))).drop("_cx", "_cy")
    if how == "inner":
        return pairs
    return left.join(pairs.select(*keys, "_id").distinct(), [*keys, "_id"], how)


def merge_intervals(df: DataFrame, keys: list[str], low: str, high: str, distance) -> DataFrame:
    """(keys, low, high, n) of intervals merged while gaps are at most distance."""
    order = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col(low) - reach <= distance, 0).otherwise(1)
    island = F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    grouped = df.withColumn("_starts", starts).withColumn("_island", island).groupBy(*keys, "_island")
    return grouped.agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n")).drop("_island")


def _joined(x0, y0, x1, y1, distance: float):
    """Least index of each box's group, groups being linked by nearness.

    Boxes are swept in order of their left sides. A grid of horizontal strips holds
    the boxes that may still be near, so a box meets only those of its own strips."""
    import numpy as np

    root = list(range(len(x0)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tall = max(1.0, float(np.median(y1 - y0)) + distance)
    strips: dict[int, list[int]] = {}
    left, low, right, high = (a.tolist() for a in (x0, y0, x1, y1))
    for i in np.lexsort((y0, x0)).tolist():
        for strip in range(int((low[i] - distance) // tall), int((high[i] + distance) // tall) + 1):
            waiting = [j for j in strips.get(strip, ()) if left[i] - right[j] <= distance]
            for j in waiting:
                if low[i] - high[j] <= distance and low[j] - high[i] <= distance:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
            waiting.append(i)
            strips[strip] = waiting
    return np.array([find(i) for i in range(len(root))])


def merge_near(boxes: list[tuple], distance: float) -> list[tuple]:
    """Boxes (x, y, w, h) merged into hulls until no two are near; sorted.

    Each round takes the connected groups of near boxes at once and puts their hulls
    in their place; hulls only grow, so the end does not depend on any order."""
    import numpy as np

    if not boxes:
        return []
    x, y, w, h = np.array(boxes).T
    sides = [x, y, x + w, y + h]
    while True:
        groups, place = np.unique(_joined(*sides, distance), return_inverse=True)
        hulls = []
        for side, take in zip(sides, (np.minimum, np.minimum, np.maximum, np.maximum), strict=True):
            out = np.full(len(groups), side.max() if take is np.minimum else side.min(), dtype=side.dtype)
            take.at(out, place, side)
            hulls.append(out)
        if len(groups) == len(sides[0]):
            return sorted(zip(*(a.tolist() for a in (hulls[0], hulls[1], hulls[2] - hulls[0], hulls[3] - hulls[1])), strict=True))
        sides = hulls


def merge_boxes(df: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """(keys, x, y, w, h) of each key's boxes after ``merge_near``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def run(table):
        import pyarrow as pa

        rows = [tuple(r[c] for c in ("x", "y", "w", "h")) for r in table.select(["x", "y", "w", "h"]).to_pylist()]
        found = merge_near(rows, distance)
        key = [pa.array([table.column(k)[0].as_py()] * len(found), table.schema.field(k).type) for k in keys]
        values = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
        return pa.Table.from_arrays(key + values, names=[*keys, "x", "y", "w", "h"])

    ints = df.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in ("x", "y", "w", "h")])
    return ints.groupBy(*keys).applyInArrow(run, f"{kinds}, x bigint, y bigint, w bigint, h bigint")
