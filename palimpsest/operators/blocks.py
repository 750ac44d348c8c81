"""Nesting over ordered operator streams, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamped_depth(df: DataFrame, keys: list[str], seq: str, step: Column, name: str = "depth") -> DataFrame:
    """df with the running depth after each row, where a step below 0 is lost:
    the plain running sum less its least value so far, if that is negative."""
    upto = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_sum", F.sum(step).over(upto))
    return df.withColumn(name, F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto))).drop("_sum")


def strip_blocks(df: DataFrame, keys: list[str], seq: str, opens: Column, closes: Column) -> DataFrame:
    """The rows outside all blocks; rows that open or close one go too."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    return clamped_depth(df, keys, seq, step, "_depth").where((F.col("_depth") == 0) & ~opens & ~closes).drop("_depth")


def scope_values(df: DataFrame, keys: list[str], seq: str, opens: Column, closes: Column, sets: Column, value: Column) -> DataFrame:
    """(keys, seq, depth, value): for every row the value that its scope holds
    after it. A value set in a scope holds there and in scopes within until it is
    set again or its scope closes; a surplus close is ignored.

    One fold with a stack over each key's rows in order.
    """
    rows = df.select(
        *keys, F.col(seq).alias("seq"), F.when(opens, 1).when(closes, -1).otherwise(0).alias("_step"), F.coalesce(sets, F.lit(False)).alias("_sets"), value.alias("value")
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "seq"]) + f", depth int, value {kinds['value']}"

    def run(table):
        import pyarrow as pa

        table = table.sort_by("seq")
        stack, depths, values = [None], [], []
        for step, is_set, v in zip(*(table.column(c).to_pylist() for c in ("_step", "_sets", "value")), strict=True):
            if step > 0:
                stack.append(stack[-1])
            elif step < 0 and len(stack) > 1:
                stack.pop()
            if is_set:
                stack[-1] = v
            depths.append(len(stack) - 1)
            values.append(stack[-1])
        held = [table.column(c) for c in [*keys, "seq"]]
        return pa.Table.from_arrays([*held, pa.array(depths, pa.int32()), pa.array(values, table.schema.field("value").type)], names=[*keys, "seq", "depth", "value"])

    return rows.groupBy(*keys).applyInArrow(run, schema)


def scope_values_joined(df: DataFrame, keys: list[str], seq: str, opens: Column, closes: Column, sets: Column, value: Column) -> DataFrame:
    """The same by windows and joins: a setting at depth d lives until the first
    later row of a depth below d; the value of a row is that of its latest living
    setting. Its work grows with the square of a key's rows."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    rows = clamped_depth(df, keys, seq, step).select(*keys, F.col(seq).alias("seq"), "depth", F.when(sets, value).alias("set"), sets.alias("sets"))
    setting = rows.where("sets").select(*keys, F.col("seq").alias("from"), F.col("depth").alias("at"), "set")
    drops = rows.select(*keys, F.col("seq").alias("later"), F.col("depth").alias("level"))
    below = setting.join(drops, keys).where("later > from and level < at")
    ends = below.groupBy(*keys, "from").agg(F.min("later").alias("until"))
    living = setting.join(ends, [*keys, "from"], "left")
    inside = (F.col("seq") >= F.col("from")) & (F.col("until").isNull() | (F.col("seq") < F.col("until")))
    latest = rows.drop("set", "sets").join(living, keys).where(inside).groupBy(*keys, "seq").agg(F.max_by("set", "from").alias("value"))
    return rows.select(*keys, "seq", "depth").join(latest, [*keys, "seq"], "left")
