"""Compares a query with its SQL on the same tables, rows in any order."""

import numbers

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    return f"{float(v):.5f}" if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(cell(v) for v in record) for record in frame[names].astype(object).itertuples(index=False))


def expected(sf, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return db.sql(sql).df()


def same(spark, sf, query, sql):
    got, want = query(spark, sf).toPandas(), expected(sf, sql)
    assert rows(got) == rows(want)
