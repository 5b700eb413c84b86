"""Spark results against DuckDB's."""

import os

import duckdb
import numpy as np
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def normal(df):
    out = {}
    for c in sorted(df.columns):
        s = df[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            s = s.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_numeric_dtype(s) and not pd.api.types.is_bool_dtype(s):
            s = s.astype("float64").round(6).map(repr)
        else:
            s = s.map(lambda v: "None" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
        out[c] = s.astype(str)
    d = pd.DataFrame(out)
    return d.sort_values(list(d.columns)).reset_index(drop=True)


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want))
