"""A query's rows against DuckDB's, without order; numbers by value."""

import datetime
import decimal
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, str, bytes)):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return datetime.datetime.combine(x, datetime.time()).isoformat()
    if isinstance(x, (list, tuple)):
        return [value(v) for v in x]
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([value(r[i]) for i in order] for r in rows), key=repr)


def duck(sql, sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    out = con.sql(sql)
    return sorted(out.columns), rows_of(out.columns, out.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])
