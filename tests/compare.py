"""Runs a query and its SQL on the same tables and compares rows, order ignored."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def _cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return (1, "")
    return (0, repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x))


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(_cell(x.item() if hasattr(x, "item") else x) for x in r) for r in frame.itertuples(index=False))


def same(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
