"""Joins between cycles, marts, lists and logs.

No side is broadcast by hint here: Spark does so below its size threshold, and above it
the adaptive planner splits skewed partitions of the row side. The list side is made
unique first, so a hot key multiplies nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import aggregate_apart


def left_join(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Left join on equal names; ``null_safe`` also pairs missing keys with each other."""
    if not null_safe:
        return left.join(right, keys, "left")
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])
    return left.join(right, cond, "left").drop(*[f"_r_{k}" for k in keys])


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is listed."""
    on = [on] if isinstance(on, str) else on
    return df.join(aggregate_apart(keys, on), on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not listed; a missing key is not listed, so it stays."""
    on = [on] if isinstance(on, str) else on
    return df.join(aggregate_apart(keys, on), on, "left_anti")


def flag_exists(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """1 where ``other`` has the key, else 0, in a single pass."""
    hits = aggregate_apart(other, keys).withColumn("_hit", F.lit(1))
    return (
        df.join(hits, keys, "left")
        .withColumn(name, F.when(F.col("_hit").isNotNull(), 1).otherwise(0))
        .drop("_hit")
    )


def join_on_month(left: DataFrame, right: DataFrame, keys: list[str], date: str,
                  year: str = "csr_year", month: str = "csr_month", how: str = "inner") -> DataFrame:
    """Join rows that carry a year and a month with rows that carry a date."""
    dated = right.withColumns({year: F.year(date), month: F.month(date)})
    return left.join(dated, [*keys, year, month], how)


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of two tables, and how many each has alone or shares."""
    left = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full")
    return both.agg(
        F.count("_a").alias("keys_a"),
        F.count("_b").alias("keys_b"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
    )
