"""Runs a query and its SQL side by side."""

import datetime
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def sql_rows(con, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return names, Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
