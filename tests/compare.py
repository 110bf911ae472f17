"""Rows of a query held against DuckDB's."""

import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    found = duckdb.connect()
    for name in NAMES:
        if Path(f"{folder}/{name}.parquet").exists():
            found.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return found


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) + 0.0 if isinstance(v, float) else v


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False)), key=repr)
