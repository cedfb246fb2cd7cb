"""Text and naming helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_suffix_names(df: DataFrame, suffix: str) -> DataFrame:
    """Remove ``suffix`` from every column name that ends with it."""
    return df.toDF(*[c.removesuffix(suffix) for c in df.columns])


def recode(col: Column, mapping: dict, default: Column | None = None) -> Column:
    """Look a value up in a small literal dictionary; unknown values stay as they are."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.coalesce(F.create_map(*pairs)[col], col if default is None else default)
