"""Run a registered query and its SQL side by side and compare the row multisets."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"create view {name} as select * from read_parquet('{path}')")
    return db


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, db, sql: str) -> str | None:
    got_columns, got = rows_of(df.columns, df.collect())
    result = db.execute(sql)
    want_columns, want = rows_of([c[0] for c in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} against {want_columns}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} rows against {sum(want.values())}; extra {extra}; missing {missing}"
    return None
