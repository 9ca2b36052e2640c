"""Compare a DataFrame with what DuckDB makes of SQL on the same tables."""

import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(df):
    """Sorted rows of a pandas frame, columns by name, floats to six places, every null alike."""

    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float):
            return round(float(x), 6) + 0.0
        return int(x) if hasattr(x, "__index__") else x

    df = df[sorted(df.columns)].astype(object)
    out = list(zip(*[[plain(x) for x in df[c]] for c in df]))
    return sorted(out, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def same(spark_df, sql, sf_dir):
    a, b = spark_df.toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
