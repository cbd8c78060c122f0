"""Spark rows against DuckDB rows, as multisets of plain values."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, sql, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    out = con.execute(sql)
    names, expected = [d[0] for d in out.description], out.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, expected)
