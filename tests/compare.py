"""Compare registered queries with their SQL, row by row."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return float(f"{float(v):.12g}")
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def compare(spark, con, fn, sql, sf_dir):
    """(same, message) for one query."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    a, names = _rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"rows only: {len(a)} rows, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    b, names_b = _rows([d[0] for d in cur.description], cur.fetchall())
    if names != names_b:
        return False, f"columns {names} <> {names_b}"
    if len(a) != len(b):
        return False, f"{len(a)} <> {len(b)} rows; e.g. {[x for x in a if x not in b][:2]} / {[x for x in b if x not in a][:2]}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return False, f"{len(diff)} of {len(a)} rows differ: {names} {diff[0]}"
    return True, f"{len(a)} rows, {t1 - t0:.1f}s"
