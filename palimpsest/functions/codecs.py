"""Stream codecs over binary columns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame


def _mapped(df: DataFrame, column: str, change) -> DataFrame:
    at = df.columns.index(column)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            arrays = list(batch.columns)
            arrays[at] = pa.array([None if x is None else change(x) for x in arrays[at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def compressed(df: DataFrame, column: str) -> DataFrame:
    """df with the binary column deflated."""
    return _mapped(df, column, lambda x: zlib.compress(bytes(x)))


def inflated(df: DataFrame, column: str) -> DataFrame:
    """df with the binary column inflated."""
    return _mapped(df, column, lambda x: zlib.decompress(bytes(x)))
