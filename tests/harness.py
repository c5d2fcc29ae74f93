"""Run a registered query and its SQL over the same tables and compare all values."""

from __future__ import annotations

import math
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 2**53 else v
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, folder):
    """(ok, message, seconds)"""
    started = time.time()
    df = query(spark, folder)
    got = df.collect()
    took = time.time() - started
    if sql is None:
        return True, f"rows only: {len(got)}", took
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took
    a, b = _rows(df.columns, got), _rows(names, want)
    if a == b:
        return True, f"{len(a)} rows", took
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return False, f"{len(a)} vs {len(b)} rows; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}; {len(sa - sb)} differ", took
