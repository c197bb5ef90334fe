"""Runs a query and its SQL over the same tables."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    rows = con.sql(sql)
    return rows.columns, rows.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def compare(df, sql):
    columns, want = duck(sql)
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    order = [columns.index(n) for n in names]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want), key=str)
