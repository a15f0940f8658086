"""Run registered queries beside their SQL and compare values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    return names, sorted((tuple(_plain(v) for v in row) for row in frame[names].itertuples(index=False)), key=repr)


def compare(spark, connection, folder: str, run, sql: str) -> str | None:
    """None when both sides agree, else the first difference."""
    got = run(spark, folder)
    names = sorted(got.columns)
    left = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
    relation = connection.sql(sql)
    if names != sorted(relation.columns):
        return f"columns {names} vs {sorted(relation.columns)}"
    at = [relation.columns.index(n) for n in names]
    right = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    if left == right:
        return None
    if len(left) != len(right):
        head = f"{len(left)} vs {len(right)} rows; "
    else:
        head = ""
    for a, b in zip(left, right, strict=False):
        if a != b:
            return f"{head}{str(a)[:700]} vs {str(b)[:700]}"
    return head
