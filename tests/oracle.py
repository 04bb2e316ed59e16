"""Comparing a query with DuckDB over the same tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def rows(df: pd.DataFrame) -> Counter:
    def one(v: object) -> str:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    columns = sorted(df.columns)
    return Counter(tuple(map(one, r)) for r in df[columns].astype(object).itertuples(index=False))
