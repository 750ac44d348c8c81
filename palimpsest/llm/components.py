"""Connected components of an edge table, by alternating large and small stars.

Each round is two grouped minima and joins on node ids; nothing but counts comes
to the driver, rounds are logarithmic in the longest path, and each round's edges
are written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _turned(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _turned(edges)
    # written, so that the join's sides are both shuffled for it and Spark may
    # split the rows of a node with very many edges
    least = common.stage_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = common.stage_table(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    joined = down.join(least, "a")
    moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node on an edge (a, b) of longs; root is the
    component's least node. Self edges and repeated edges don't matter."""
    current = common.stage_table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    sign = None
    for _ in range(max_rounds):
        following = common.stage_table(_small_star(_large_star(current)), "edges")
        common.drop_path(edges.sparkSession, current._staged_path)
        current = following
        row = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == row:
            break
        sign = row
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
