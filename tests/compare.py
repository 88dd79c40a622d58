"""Runs queries beside their SQL in DuckDB and compares names, counts and values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x if isinstance(x, str) or x is None else str(x)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same rows, whatever their order."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    rows = lambda many, own: sorted((str([plain(r[own.index(c)]) for c in order]) for r in many))
    a, b = rows(df.collect(), df.columns), rows(want.fetchall(), names)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    return f"{len(a)} rows against {len(b)}; only here: {sorted(sa - sb)[:3]}; only there: {sorted(sb - sa)[:3]}"
