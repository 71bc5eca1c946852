"""Comparison of a Spark result with DuckDB on the same tables."""

import os

import duckdb
import numpy as np


def _plain(v):
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in v.items())
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6) + 0.0
    if isinstance(v, np.integer):
        return int(v)
    return v


def rows(frame, columns):
    return sorted(repr(_plain(r)) for r in frame[columns].itertuples(index=False, name=None))


def duck(sf):
    c = duckdb.connect()
    for x in os.listdir(sf):
        c.execute(f"CREATE VIEW {x.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{x}')")
    return c


def agree(spark, sf, f, sql):
    got, want = f(spark, sf).toPandas(), duck(sf).execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
    return got
