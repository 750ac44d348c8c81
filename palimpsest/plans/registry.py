"""All queries of the masking engine and their reference SQL, by name."""

from __future__ import annotations

from palimpsest.plans import analogues

#: name -> (Spark query, DuckDB SQL or None)
_ALL = analogues.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
