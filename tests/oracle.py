"""A query's rows against those of its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    x = x.item() if hasattr(x, "item") else x
    if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
        return None
    if isinstance(x, float):
        return int(x) if math.isfinite(x) and x == int(x) else x
    return x


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(repr(tuple(map(_plain, r))) for r in pdf.itertuples(index=False, name=None))


def compare(spark, query, sql, folder=FOLDER):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
