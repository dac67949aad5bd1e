"""Spark rows against DuckDB rows of the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(folder: str):
    held = duckdb.connect()
    for name in TABLES:
        held.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return held


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, "nan") if math.isnan(value) else (2, f"{value + 0.0:.9g}")
    if isinstance(value, int):
        return (2, f"{float(value):.9g}" if abs(value) < 2**53 else str(value))
    return (3, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, folder, name, query, sql):
    """None when equal, otherwise a short description of the difference."""
    frame = query(spark, folder)
    found = frame.collect()
    held = connection(folder).execute(sql)
    columns = [c[0] for c in held.description]
    wanted = held.fetchall()
    if sorted(frame.columns) != sorted(columns):
        return f"{name}: columns {sorted(frame.columns)} != {sorted(columns)}"
    a, b = rows_of(frame.columns, found), rows_of(columns, wanted)
    if a == b:
        return None
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"{name}: {len(a)} rows != {len(b)} rows\n  spark {str(only_a)[:600]}\n  sql   {str(only_b)[:600]}"
