"""Rows of Spark and DuckDB in one form, so that they can be compared as multisets."""

import glob
import math
import os
from collections import Counter

import pandas as pd


def canonical(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(canonical, v))
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return str(v if v.tzinfo is None else v.tz_convert("UTC").tz_localize(None))
    return str(v) if hasattr(v, "isoformat") else v


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, Counter(tuple(canonical(v) for v in r) for r in pdf[cols].itertuples(index=False))


def duck(directory):
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{directory}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c
