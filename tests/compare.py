"""Compare a Spark result with what DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "-"
    if isinstance(x, (bool,)) or type(x).__name__ == "bool":
        return str(bool(x))
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    try:
        return f"{float(x):.9g}"
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(_cell, r)) for r in df[columns].itertuples(index=False, name=None))


def same(spark_df, sql, con):
    a, b = rows(spark_df.toPandas()), rows(con.sql(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    wrong = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not wrong, wrong[:3]
