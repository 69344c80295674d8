"""Compares a registered query with its DuckDB SQL, as the driver does."""

import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            path = f"{sf_dir}/{name}"
            con.execute(f"create view {name[:-8]} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


def rows_of_sql(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=str)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (float, int)):
        return a == b or abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    return a == b


def assert_same(df, con, sql):
    (c1, a), (c2, b) = rows_of(df), rows_of_sql(con, sql)
    assert c1 == c2
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if not all(map(close, x, y))]
    assert not bad, bad[:3]
