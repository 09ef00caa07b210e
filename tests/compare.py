"""Comparison of a query's rows with those of its SQL."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


def same(df, con, sql):
    """Assert that a DataFrame and a SQL text give the same columns and rows."""
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    assert got == expected
    return len(got)
