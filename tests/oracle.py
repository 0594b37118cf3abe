"""The comparison of a query with its SQL on DuckDB."""

import math
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        p = os.path.join(folder, f)
        p = p + "/*.parquet" if os.path.isdir(p) else p
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{p}')")
    return c


def text(x) -> str:
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(text, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return str(int(x)) if float(x).is_integer() else repr(round(float(x), 6))
    return str(x)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted("|".join(map(text, r)) for r in df.itertuples(index=False, name=None))
