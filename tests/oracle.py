"""Runs a query on Spark and its SQL on DuckDB and compares values, ignoring row order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str, query: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = con.execute(query)
    return [c[0] for c in got.description], got.fetchall(), [str(c[1]) for c in got.description]


def mismatch(df, folder: str, query: str) -> str | None:
    """None when both sides agree, else what differs."""
    names, rows, _ = duck(folder, query)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(names, rows)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(names)}: {x!r} against {y!r}"
    return None
