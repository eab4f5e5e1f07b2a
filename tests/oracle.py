"""Run a registered query and its SQL oracle and compare the answers."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

TIMES: dict[str, float] = {}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for table in TABLES:
        path = os.path.join(folder, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if value else "0"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, name: str, fn, sql: str) -> tuple[str, int]:
    """('' or a description of the difference, number of rows)."""
    began = time.time()
    got = fn(spark, folder)
    rows = got.collect()
    TIMES[name] = time.time() - began
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got.columns) != sorted(want_columns):
        return f"columns {sorted(got.columns)} != {sorted(want_columns)}", len(rows)
    left, right = _sorted(got.columns, rows), _sorted(want_columns, want)
    if left == right:
        return "", len(rows)
    a, b = set(left), set(right)
    return (
        f"rows {len(left)} vs {len(right)}; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}",
        len(rows),
    )
