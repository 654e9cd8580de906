"""Compare a registered query with its DuckDB statement: names, row count, sorted values."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

from headwater.plans.queries import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value) -> str:
    if value is None:
        return "~"
    if isinstance(value, float):
        return "~" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def _rows(names: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs first."""
    expected = con.sql(sql)
    if sorted(df.columns) != sorted(expected.columns):
        return f"columns {sorted(df.columns)} vs {sorted(expected.columns)}"
    got = _rows(df.columns, df.collect())
    want = _rows(expected.columns, expected.fetchall())
    if got == want:
        return None
    missing = sorted(set(want) - set(got))[:3]
    extra = sorted(set(got) - set(want))[:3]
    return f"rows {len(got)} vs {len(want)}; only in SQL {missing}; only in Spark {extra}"
