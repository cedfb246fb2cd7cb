"""Comparison of a Spark result with DuckDB's, order-insensitive."""

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return int(v)
    if hasattr(v, "item"):
        return _plain(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    values = [tuple(_plain(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(values, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def differences(spark_pdf, duck_pdf, limit=3):
    """Empty text if both hold the same rows."""
    a_cols, a = rows_of(spark_pdf)
    b_cols, b = rows_of(duck_pdf)
    if a_cols != b_cols:
        return f"columns {a_cols} <> {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} <> {len(b)}; spark {a[:limit]} duckdb {b[:limit]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ: {bad[:limit]}"
    kinds = []
    for c in a_cols:
        x, y = spark_pdf[c].dtype, duck_pdf[c].dtype
        # whole numbers with nulls are floats on one side and nullable integers on the other
        some_null = spark_pdf[c].isna().any() and {x.kind, y.kind} == {"i", "f"}
        if x.kind != y.kind and len(a) and not some_null:
            kinds.append(f"{c}: {x} <> {y}")
    return "kinds " + "; ".join(kinds) if kinds else ""
