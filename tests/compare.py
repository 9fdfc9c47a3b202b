"""Compare a Spark result with its SQL counterpart, ignoring row order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(base: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(base).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value + 0.0, 6) + 0.0
    if isinstance(value, bool) or value is None:
        return str(value)
    return value


def _sort_key(row):
    return tuple(str(v) for v in row)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=_sort_key)


def difference(spark_df, connection, sql: str) -> str | None:
    """None when equal, else a short description."""
    ours, our_rows = normalised(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = connection.execute(sql)
    theirs, their_rows = normalised([d[0] for d in cursor.description], cursor.fetchall())
    if ours != theirs:
        return f"columns {ours} != {theirs}"
    if len(our_rows) != len(their_rows):
        return f"{len(our_rows)} rows != {len(their_rows)}"
    wrong = [(a, b) for a, b in zip(our_rows, their_rows, strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(our_rows)} rows differ, e.g. {wrong[0]}"
    return None
