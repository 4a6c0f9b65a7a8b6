"""Run a registered query and its SQL counterpart, and compare whole results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(folder) / name}.parquet'")
    return connection


def _cell(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "" if math.isnan(value) else repr(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, connection, sql: str) -> list[str]:
    """Empty if both sides have the same columns and rows, else what differs."""
    columns, mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    other_columns, other = _rows([d[0] for d in result.description], result.fetchall())
    if columns != other_columns:
        return [f"columns {columns} against {other_columns}"]
    if mine == other:
        return []
    left, right = set(mine), set(other)
    only = [f"only Spark: {r}"[:600] for r in sorted(left - right)[:3]]
    only += [f"only SQL: {r}"[:600] for r in sorted(right - left)[:3]]
    return [f"rows {len(mine)} against {len(other)}", *only]
