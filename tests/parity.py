"""Holds a query's rows against its SQL in DuckDB."""

import glob
import os

import duckdb


def views(root):
    con = duckdb.connect()
    for p in glob.glob(f"{root}/*.parquet"):
        at = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{at}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "NaN" if x != x else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_in_sql(con, text):
    rel = con.sql(text)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
