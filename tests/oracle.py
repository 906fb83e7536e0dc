"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    if isinstance(v, bytearray | bytes):
        return bytes(v)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> int:
    got = query(spark, sf_dir)
    left = rows(got.columns, [tuple(r) for r in got.collect()])
    want = duck(sf_dir).execute(sql)
    names = [d[0] for d in want.description]
    right = rows(names, want.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert len(left) == len(right), (len(left), len(right))
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    assert not wrong, wrong[:3]
    return len(left)
