"""Comparison of a query's rows with those of its reference SQL in DuckDB."""

import decimal
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if v == v else "nan"
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(sql, sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf}/{f}") else "")
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    out = con.sql(sql)
    cols = sorted(out.columns)
    at = [out.columns.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)
