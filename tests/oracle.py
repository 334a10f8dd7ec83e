"""Runs a query and its SQL side by side: same columns, and same rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return x


def key(row: tuple) -> tuple:
    return tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in row)


def mismatch(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    names = sorted(spark_df.columns)
    found = sorted((tuple(plain(r[n]) for n in names) for r in spark_df.collect()), key=key)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    at = [columns.index(n) for n in names]
    wanted = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=key)
    if len(found) != len(wanted):
        return f"{len(found)} rows and {len(wanted)}; {found[:2]} {wanted[:2]}"
    for a, b in zip(found, wanted, strict=True):
        if a != b:
            return f"{names}: {a} and {b}"
    return None
