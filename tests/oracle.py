"""Compare a Spark result with its DuckDB twin, column names and values."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    # Integers with nulls come as floats from one side and as integers from the other.
    whole = [c for c in columns if frame[c].dtype.kind == "f" and frame[c].isna().any() and (frame[c].dropna() % 1 == 0).all()]
    frame = frame.astype({c: "Int64" for c in whole})
    out = []
    for row in frame[columns].itertuples(index=False):
        out.append(tuple(
            "NULL" if v is None or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
            for v in row
        ))
    return columns, sorted(out)


def compare(spark_frame, duck_frame) -> str | None:
    left_cols, left = rows_of(spark_frame)
    right_cols, right = rows_of(duck_frame)
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right, strict=True):
        if a != b:
            return f"first difference in {left_cols}:\n  spark {a}\n  duck  {b}"
    kinds = [(c, spark_frame[c].dtype.kind, duck_frame[c].dtype.kind) for c in left_cols]
    odd = [k for k in kinds if k[1] != k[2] and "f" not in (k[1], k[2]) and len(left)]
    return f"types differ: {odd}" if odd else None
