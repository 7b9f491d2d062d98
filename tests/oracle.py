"""Comparing a query with its SQL on the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


def rows(columns: list[str], values) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_value(v[k]) for k in order) for v in values)


def differences(df, sql: str, con) -> str:
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    want, have = rows(columns, got.fetchall()), rows(df.columns, df.collect())
    more, less = have - want, want - have
    return "" if not (more or less) else f"{sum(more.values())} rows only in Spark, e.g. {list(more)[:2]}; {sum(less.values())} only in SQL, e.g. {list(less)[:2]}"
