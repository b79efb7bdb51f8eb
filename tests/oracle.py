"""Compares a Spark result with DuckDB SQL over the same tables: columns by name, rows as a multiset."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    if isinstance(v, (int, float)) or hasattr(v, "__float__"):
        f = float(v)
        return None if math.isnan(f) else f + 0.0
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, sf_dir: str = SMALL) -> list:
    """Empty if equal; else what differs, at most five rows of each side."""
    ran = connect(sf_dir).execute(sql)
    names = [d[0] for d in ran.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, ran.fetchall())
    if ours == theirs:
        return []
    a, b = set(ours), set(theirs)
    return [("rows", len(ours), len(theirs)), ("spark", sorted(a - b, key=repr)[:5]), ("duckdb", sorted(b - a, key=repr)[:5])]
