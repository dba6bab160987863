"""Compare a registered query with its SQL oracle, value by value, without regard to order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(x: object) -> object:
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(cell(v) for v in x)
    return str(x)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, q, con=None) -> tuple[int, str]:
    """Row count and '' when equal, else what differs."""
    df = q.plan(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = (con or connect(sf_dir)).execute(q.oracle)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns {sorted(set(df.columns) ^ set(names))}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return len(got), f"{len(bad)} rows differ in {sorted(names)}:\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    return len(got), ""
