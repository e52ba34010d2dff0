"""Compares a query with its SQL: columns by name, rows in any order, values in a canonical form."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def canonical(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, str, bytes)):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, (int, float)):
        return round(float(x), 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(canonical(y) for y in x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(canonical(r[i]) for i in order) for r in data)


def kinds(names, types):
    return dict(zip(names, map(str, types), strict=True))


def compare(spark, sf, fn, sql):
    """None if equal, else what differs."""
    df = fn(spark, sf)
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connection(sf).sql(sql)
    want_names, want = rows(list(rel.columns), rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} {want_names}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only ours {list((got - want).items())[:3]}; only theirs {list((want - got).items())[:3]}"
    return None
