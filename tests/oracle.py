"""Comparing Spark results with DuckDB results."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def compare(df, con, sql):
    """None if equal, else a description of the first difference."""
    columns, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    other_columns, theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if columns != other_columns:
        return f"columns {columns} vs {other_columns}"
    if len(ours) != len(theirs):
        missing = sorted(set(theirs) - set(ours), key=repr)[:2]
        extra = sorted(set(ours) - set(theirs), key=repr)[:2]
        return f"rows {len(ours)} vs {len(theirs)}; only oracle {missing}; only ours {extra}"
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"ours {a} oracle {b}"
    return None
