"""Compare a Spark result with DuckDB's for the same query, value by value."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def normal(pdf: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(pdf.columns):
        s = pdf[c]
        if str(s.dtype).startswith("datetime"):
            s = s.dt.strftime("%Y-%m-%d")
        elif s.dtype == object and len(s) and hasattr(s.iloc[0], "isoformat"):
            s = s.map(lambda d: d.isoformat()[:10])
        elif str(s.dtype) == "float64":
            s = s + 0.0
        out[c] = s
    frame = pd.DataFrame(out)
    return frame.sort_values(list(frame.columns), ignore_index=True, na_position="first")


def differences(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> list[str]:
    a, b = normal(spark_pdf), normal(duck_pdf)
    if list(a.columns) != list(b.columns):
        return [f"columns {list(a.columns)} != {list(b.columns)}"]
    if len(a) != len(b):
        return [f"rows {len(a)} != {len(b)}"]
    out = []
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype == object or y.dtype == object:
            same = (x == y) | (x.isna() & y.isna())
        else:
            same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = (~same).idxmax()
            out.append(f"{c}: {int((~same).sum())} differ, e.g. {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}")
        elif x.dtype != y.dtype and not (x.dtype == object or y.dtype == object):
            out.append(f"{c}: dtype {x.dtype} vs {y.dtype}")
    return out
