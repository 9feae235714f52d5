"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def canonical(frame: pd.DataFrame) -> list:
    def value(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return repr(v)
        return f"{float(v):.9g}" if isinstance(v, (int, float)) else repr(v)

    names = sorted(frame.columns)
    return [names, *sorted([tuple(map(value, r)) for r in frame[names].itertuples(index=False)])]


def with_sql(sql: str, folder: str) -> pd.DataFrame:
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for path in glob.glob(f"{folder}/*.parquet"):
            name = os.path.basename(path).removesuffix(".parquet")
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        return db.execute(sql).fetchdf()
