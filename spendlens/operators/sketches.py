"""Distinct counts by mergeable sketches, where an exact count would shuffle every key.

A sketch has a fixed size whatever it has seen, is filled on the map side, and sketches of parts (days, files,
sources) merge into that of the whole. The exact counts stay the default: ``keys_per_dim``, ``coverage``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_SIZE = 14  # a theta sketch keeps at most 2 ** LOG_SIZE hashes: relative error about 1 / sqrt of that, 0.8 %


def distinct_sketches(df: DataFrame, key: str, by: list[str] | None = None, log_size: int = LOG_SIZE) -> DataFrame:
    """(by..., ``sketch``): a theta sketch of the keys, per group or of the whole table; null keys and groups are left out."""
    kept = df.where(F.col(key).isNotNull())
    if not by:
        return kept.agg(F.theta_sketch_agg(key, log_size).alias("sketch"))
    return kept.dropna(subset=by).groupBy(*by).agg(F.theta_sketch_agg(key, log_size).alias("sketch"))


def merged(sketches: DataFrame, by: list[str] | None = None, log_size: int = LOG_SIZE) -> DataFrame:
    """Sketches of parts put together, per group or all."""
    union = F.theta_union_agg("sketch", log_size).alias("sketch")
    return sketches.groupBy(*by).agg(union) if by else sketches.agg(union)


def approx_keys_per_dim(df: DataFrame, key: str, dim: str, log_size: int = LOG_SIZE) -> DataFrame:
    """Distinct keys seen with each value of a dimension, from one sketch per value."""
    return distinct_sketches(df, key, [dim], log_size).select(dim, F.theta_sketch_estimate("sketch").alias("keys"))


def approx_coverage(a: DataFrame, b: DataFrame, key: str, log_size: int = LOG_SIZE) -> DataFrame:
    """Distinct keys of two tables, and how many each has alone or shares, from one sketch of each: no key is shuffled or joined.

    The error of ``shared`` and of the differences is that of the larger table, so a small overlap of large tables is rough."""
    left, right = (distinct_sketches(t, key, None, log_size).select(F.col("sketch").alias(n)) for t, n in ((a, "x"), (b, "y")))
    both = left.withColumn("y", right.scalar())
    count = F.theta_sketch_estimate
    return both.select(
        count("x").alias("keys_a"), count("y").alias("keys_b"), count(F.theta_intersection("x", "y")).alias("shared"),
        count(F.theta_difference("x", "y")).alias("only_a"), count(F.theta_difference("y", "x")).alias("only_b"))
