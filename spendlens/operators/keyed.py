"""Per-key aggregates meant to be joined back on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate_apart(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """``groupBy(keys).agg(aggs)`` (or the distinct keys) in partitions of its own.

    Adaptive execution splits a hot join partition only if both sides come straight from a
    shuffle. An ordinary aggregate would already be partitioned by the keys and sit between
    its shuffle and the join; grouped by the keys as one struct it is shuffled again, one
    row per key, and the row side can be split.
    """
    rows = df.select(F.struct(*keys).alias("_k"), *df.columns) if aggs else df.select(F.struct(*keys).alias("_k"))
    out = rows.groupBy("_k").agg(*aggs) if aggs else rows.distinct()
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *[c for c in out.columns if c != "_k"])
