"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value: object) -> object:
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def mismatch(spark, fn, sql: str, sf_dir: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """NULL when both engines agree, else a short description."""
    found = fn(spark, sf_dir)
    got = [tuple(r) for r in found.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(found.columns) != sorted(names):
        return f"columns {sorted(found.columns)} vs {sorted(names)}"
    left, right = _rows(found.columns, got), _rows(names, want)
    if left == right:
        return None
    only_left, only_right = list((left - right).items())[:3], list((right - left).items())[:3]
    return f"{len(got)} vs {len(want)} rows; only spark {only_left}; only sql {only_right}; columns {sorted(names)}"
