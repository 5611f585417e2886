"""Rows of a query and of its SQL, comparable."""

import decimal
import math
import os


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.split('.')[0]} as from '{folder}/{name}'")
    return con


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, dict):
        return tuple(norm(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def same(spark, con, query, sql, folder):
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = sorted((tuple(norm(v) for v in r) for r in df.select(columns).collect()), key=repr)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(norm(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert mine == theirs
