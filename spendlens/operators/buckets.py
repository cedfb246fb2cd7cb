"""Calendar buckets, dense matrices and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bucket_days, bucket_index, bucket_label, bucket_start, label_of
from ..functions.numbers import cents, exact_avg, exact_sum


def bucket_contained(df: DataFrame, grain: str, start: str = "started", end: str = "ended",
                     keep_all: bool = False) -> DataFrame:
    """Cycles that lie inside one calendar bucket, with its number. No join is needed.

    ``keep_all`` keeps the other cycles, without a number, so that no key is lost.
    """
    a, b = bucket_index(F.col(start), grain), bucket_index(F.col(end), grain)
    tagged = df.withColumn("bucket_idx", F.when(a == b, a))
    return tagged if keep_all else tagged.where(F.col("bucket_idx").isNotNull())


def bucket_overlap(df: DataFrame, grain: str, start: str = "started", end: str = "ended",
                   mode: str = "overlap", keep_all: bool = False) -> DataFrame:
    """One row per cycle and bucket it touches; ``keep_all`` also keeps cycles that touch none.

    ``overlap`` uses half-open buckets. ``legacy`` keeps the published three-case test,
    which misses cycles that cover a whole bucket and the last day of a quarter.
    """
    a, b = bucket_index(F.col(start), grain), bucket_index(F.col(end), grain)
    touched = F.when(F.col(start) <= F.col(end), F.sequence(a, b))
    out = df.withColumn("bucket_idx", (F.explode_outer if keep_all else F.explode)(touched))
    if mode == "overlap":
        return out
    lo, hi = legacy_bounds(F.col("bucket_idx"), grain)
    s, e = F.col(start), F.col(end)
    inside = (s >= lo) & (e < hi)
    runs_out = (s >= lo) & (s < hi) & (e > hi)
    runs_in = (e >= lo) & (e < hi) & (s < lo)
    hit = inside | runs_out | runs_in
    if keep_all:
        return out.withColumn("bucket_idx", F.when(hit, F.col("bucket_idx")))
    return out.where(hit)


def legacy_bounds(index: Column, grain: str) -> tuple[Column, Column]:
    """Bucket limits as published: quarters end on their last day, months on the first day
    of the next, and December on its 31st."""
    lo, nxt = bucket_start(index, grain), bucket_start(index + 1, grain)
    if grain == "quarter":
        return lo, F.date_sub(nxt, 1)
    return lo, F.when(F.month(lo) == 12, F.date_sub(nxt, 1)).otherwise(nxt)


def prorate(df: DataFrame, keys: list[str], grain: str, budget: str = "budget", start: str = "started",
            end: str = "ended", mode: str = "overlap", keep_all: bool = False) -> DataFrame:
    """Budget per key and bucket, each cycle scaled by its days over the bucket's days.

    ``overlap`` counts the days inside the bucket, ``legacy`` all days of the cycle. Cents
    times days are added as integers and divided once.
    """
    touched = bucket_overlap(df, grain, start, end, mode, keep_all)
    idx = F.col("bucket_idx")
    if mode == "overlap":
        days = F.datediff(F.least(F.col(end), bucket_start(idx + 1, grain)),
                          F.greatest(F.col(start), bucket_start(idx, grain)))
        span = bucket_days(idx, grain)
    else:
        lo, hi = legacy_bounds(idx, grain)
        span = F.datediff(hi, lo)
        days = F.datediff(F.col(end), F.col(start))
    summed = touched.dropna(subset=keys).groupBy(*keys, "bucket_idx", span.alias("_span")).agg(
        F.sum(cents(F.col(budget)) * days).alias("_centdays")
    )
    return summed.select(
        *keys, "bucket_idx", (F.col("_centdays") / (F.lit(100.0) * F.col("_span"))).alias("value")
    )


def bucket_values(df: DataFrame, keys: list[str], value: str, agg: str = "mean") -> DataFrame:
    """Mean or total budget per key and bucket, in one aggregation."""
    fold = {"mean": exact_avg, "sum": exact_sum}[agg]
    return df.dropna(subset=keys).groupBy(*keys, "bucket_idx").agg(fold(F.col(value)).alias("value"))


def densify(df: DataFrame, key: str, first: int, last: int, fill: float = 0.0) -> DataFrame:
    """Every key with every bucket number ``first .. last``; empty ones hold ``fill``.

    The present buckets of a key fit one map (the calendar bounds them), which is laid over
    the full range of numbers. A row without a bucket number only keeps its key alive.
    """
    in_range = F.col("bucket_idx").between(first, last)
    entries = F.collect_list(F.when(in_range, F.struct("bucket_idx", "value")))
    spans = df.groupBy(key).agg(F.map_from_entries(entries).alias("_have"))
    got = F.try_element_at("_have", F.col("bucket_idx"))
    return (
        spans.withColumn("bucket_idx", F.explode(F.sequence(F.lit(first), F.lit(last))))
        .select(key, "bucket_idx", F.coalesce(got, F.lit(fill)).alias("value"))
    )


def with_labels(df: DataFrame, grain: str, name: str = "bucket") -> DataFrame:
    return df.withColumn(name, bucket_label(F.col("bucket_idx"), grain))


def to_matrix(df: DataFrame, key: str, grain: str, first: int, last: int) -> DataFrame:
    """Wide matrix with one column per bucket label, zero where nothing was booked."""
    marks = list(range(first, last + 1))
    wide = df.groupBy(key).pivot("bucket_idx", marks).agg(F.sum("value")).na.fill(0.0)
    return wide.toDF(key, *[label_of(i, grain) for i in marks])


def to_series(df: DataFrame, key: str, columns: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """Wide rows to (key, t, x), t counting the columns from 0."""
    cells = F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in columns])).alias(t, x)
    return df.select(key, cells)


def quarter_profile(df: DataFrame, key: str, value: str = "budget", start: str = "started",
                    end: str = "ended") -> DataFrame:
    """Four columns per key: for every quarter of the year, the yearly means added up in time order."""
    yearly = bucket_values(bucket_contained(df, "quarter", start, end), [key], value, "mean")
    quarter = F.col("bucket_idx") % 4 + 1
    # at most one value per year: sorted first, so that the total does not depend on arrival
    dated = F.struct("bucket_idx", F.coalesce("value", F.lit(0.0)).alias("value"))
    total = lambda q: F.aggregate(
        F.array_sort(F.collect_list(F.when(quarter == q, dated))), F.lit(0.0), lambda acc, e: acc + e["value"]
    )
    return yearly.groupBy(key).agg(*[total(q).alias(f"q{q}") for q in range(1, 5)])


def one_hot(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """One 0/1 column per listed value."""
    return df.withColumns({
        f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values
    })


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "column",
         value: str = "value") -> DataFrame:
    """Columns to rows (id, column, value)."""
    return df.unpivot(ids, values, variable, value)


def metric_series(df: DataFrame, key: str, order: list[str], metrics: list[str]) -> DataFrame:
    """Ordered values of several metrics per key: rows (key, metric, idx, x).

    Rows of one key and time are added up first, so a series is no longer than its calendar.
    """
    summed = df.where(F.col(key).isNotNull()).groupBy(key, *order).agg(*[
        F.sum(F.col(m).cast("double")).alias(m) for m in metrics
    ])
    placed = summed.withColumn(
        "idx", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    )
    return placed.unpivot([key, "idx"], metrics, "metric", "x")
