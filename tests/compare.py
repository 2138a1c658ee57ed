"""Compares a Spark query with its SQL on the same tables."""

import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(table, columns):
    return sorted((tuple(plain(x) for x in r) for r in table), key=lambda r: tuple(map(str, r)))


def same(df, con, sql):
    columns = sorted(df.columns)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    got = rows(df.select(*[f"`{c}`" for c in columns]).collect(), columns)
    want = rows(([r[i] for i in at] for r in cur.fetchall()), columns)
    assert got == want
