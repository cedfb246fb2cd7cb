"""Budget by category (or advertiser) and calendar bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.buckets import bucket_contained, bucket_values, densify, prorate, to_matrix, with_labels
from ..operators.clean import order_dates


def budget_matrix(df: DataFrame, dim: str, grain: str, first: int, last: int, agg: str = "mean",
                  budget: str = "budget", start: str = "started", end: str = "ended",
                  wide: bool = False, mode: str = "overlap") -> DataFrame:
    """Dense table (dim, bucket_idx, bucket, value), or one column per bucket if ``wide``.

    ``mean`` and ``sum`` fold the cycles that lie inside a bucket; ``prorated`` spreads each
    cycle over the buckets it touches. A missing text dimension becomes ``Other``.
    """
    if dict(df.dtypes)[dim] == "string":
        df = df.na.fill({dim: "Other"})
    ordered = order_dates(df, start, end)
    # cycles outside every bucket stay in, so that their key gets a row of zeros
    if agg == "prorated":
        booked = prorate(ordered, [dim], grain, budget, start, end, mode, keep_all=True)
    else:
        tagged = bucket_contained(ordered, grain, start, end, keep_all=True)
        booked = bucket_values(tagged, [dim], budget, agg)
    dense = densify(booked, dim, first, last)
    if wide:
        return to_matrix(dense, dim, grain, first, last)
    return with_labels(dense, grain)
