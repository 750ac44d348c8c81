"""Queries with SQL agree with DuckDB on the smallest tables."""

import duckdb
import pytest

from palimpsest.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    rows = lambda f: f[sorted(f.columns)].astype(str).sort_values(sorted(f.columns)).reset_index(drop=True)
    assert rows(got).equals(rows(want))
