"""Object graphs: reachable sets, dense renumbering, inherited entries.

Nodes are (doc, id); edges are (doc, src, dst). Graphs may hold cycles, so
reachability is a loop over frontiers; each round is written to the session's
checkpoint folder, or kept in memory where the session has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def reachable(roots: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Distinct (doc, id) that can be reached from roots (doc, id)."""
    seen = _cut(roots.select("doc", "id").distinct())
    frontier = seen
    for _ in range(max_rounds):
        step = frontier.withColumnRenamed("id", "src").join(edges, ["doc", "src"]).select("doc", F.col("dst").alias("id")).distinct()
        frontier = _cut(step.join(seen, ["doc", "id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = _cut(seen.unionByName(frontier))
    raise RuntimeError("graph deeper than max_rounds")


def renumbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with ``new_id``, dense from 1 within each doc."""
    return nodes.withColumn("new_id", F.row_number().over(Window.partitionBy("doc").orderBy(*order)))


def copied(nodes: DataFrame, edges: DataFrame, roots: DataFrame, drop: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) reachable from roots, each object once, under new numbers;
    edges for which drop holds (such as parent links) are not followed."""
    kept_edges = edges if drop is None else edges.where(~drop)
    held = renumbered(reachable(roots, kept_edges), ["id"])
    new = kept_edges.join(held.select("doc", F.col("id").alias("src"), F.col("new_id").alias("new_src")), ["doc", "src"])
    new = new.join(held.select("doc", F.col("id").alias("dst"), F.col("new_id").alias("new_dst")), ["doc", "dst"])
    return nodes.join(held, ["doc", "id"]), new


def inherited(nodes: DataFrame, value: str, parent: str = "parent", max_depth: int = 64) -> DataFrame:
    """(doc, id, value): a node's own value, or that of its nearest ancestor."""
    found = nodes.select("doc", "id", F.col(parent).alias("up"), F.col(value).alias("value"))
    above = nodes.select("doc", F.col("id").alias("up"), F.col(parent).alias("next"), F.col(value).alias("theirs"))
    for _ in range(max_depth):
        if found.where("value is null and up is not null").isEmpty():
            break
        found = found.join(above, ["doc", "up"], "left").select(
            "doc", "id", F.when(F.col("value").isNull(), F.col("next")).alias("up"), F.coalesce("value", "theirs").alias("value")
        )
        found = _cut(found)
    return found.select("doc", "id", "value")
