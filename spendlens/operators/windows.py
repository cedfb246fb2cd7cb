"""Window operators.

Two kinds of input:

* a *series* has one row per (key, t), with t from a bounded calendar (months, quarters,
  days). Its keys hold at most a few thousand rows however large the source is, because
  the source was aggregated on (key, t) first; plain windows per key are safe.
* *cycle rows* are unbounded per key. Operators on them never window over the rows of a
  key; they window over its distinct dates and join the result back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(key: str | list[str], *order: str):
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(*order)


def whole(key: str | list[str]):
    return Window.partitionBy(*([key] if isinstance(key, str) else key))


# --- cycle rows ---------------------------------------------------------------------------


def start_days(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """One row per (key, start date): the first and the last end, the number of cycles, the last end
    of the start date before (``prev_end``), and the key's first start.

    A key has at most one row per calendar day here, whatever the number of its cycles; only these rows are windowed per key.
    """
    days = (
        df.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
        .groupBy(key, start).agg(F.min(end).alias("first_end"), F.max(end).alias("last_end"), F.count("*").alias("copies"))
    )
    order = along(key, start)
    return days.withColumns({
        "prev_end": F.lag("last_end").over(order),
        "first_start": F.first(start).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })


def cycle_steps(df: DataFrame, key: str, start: str, end: str, id_: str) -> DataFrame:
    """Distinct (key, start, end) with the end before them, the first id among their copies
    and the key's first start.

    In the order (start, end, id) only the first copy of a pair of dates can follow another pair; the others follow a copy
    of themselves. What a pair follows is the pair before it of the same start date, or the last end of the start date before.
    """
    pairs = (
        df.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
        .groupBy(key, start, end).agg(F.min(id_).alias("first_id"))
        .withColumn("_same_day", F.lag(end).over(along([key, start], end)))
    )
    days = start_days(df, key, start, end).select(
        F.col(key).alias("_key"), F.col(start).alias("_start"), F.col("prev_end").alias("_day_before"), "first_start")
    return pairs.join(days, (F.col(key) == F.col("_key")) & (F.col(start) == F.col("_start"))).select(
        key, start, end, "first_id", "first_start", F.coalesce("_same_day", "_day_before").alias("prev_end"))


def cycle_gaps(df: DataFrame, key: str, start: str = "started", end: str = "ended",
               id_: str = "cycle_id") -> DataFrame:
    """Days from the previous cycle's end to this start (0 for the first; overlaps negative),
    and the running sum of duration plus gap.

    The sum telescopes: added up to any cycle it is the time from the first start to that
    cycle's end, so no cumulative window is needed.
    """
    steps = cycle_steps(df, key, start, end, id_)
    first_copy = F.col(id_) == F.col("first_id")
    gap = F.when(first_copy, F.coalesce(F.datediff(start, "prev_end"), F.lit(0))).otherwise(
        F.datediff(start, end)
    )
    return df.join(steps, [key, start, end]).select(
        *df.columns, gap.cast("long").alias("gap"),
        F.datediff(end, "first_start").cast("long").alias("running"),
    )


# --- series: smoothing and differences ----------------------------------------------------


def running_sum(df: DataFrame, key: str, t: str, x: str, name: str = "running") -> DataFrame:
    w = along(key, t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(x).over(w))


def moving_average(key: str, t: str, x: str, w: int) -> Column:
    """Centred mean over ``w`` points; points outside the series count as zero.

    An even window leans to the past: w/2 points before, w/2 - 1 after.
    """
    frame = along(key, t).rowsBetween(-(w // 2), (w - 1) // 2)
    return F.sum(x).over(frame) / F.lit(float(w))


def centered_ma(df: DataFrame, key: str, t: str, x: str, w: int, name: str = "ma") -> DataFrame:
    return df.withColumn(name, moving_average(key, t, x, w))


def detrend(df: DataFrame, key: str, t: str, x: str, w: int, name: str = "detrended") -> DataFrame:
    """Series minus its moving average; a series shorter than the window shrinks the window."""
    n = F.count("*").over(whole(key))
    ma = moving_average(key, t, x, w)
    for size in range(1, w):
        ma = F.when(n == size, moving_average(key, t, x, size)).otherwise(ma)
    return df.withColumn(name, F.col(x) - ma)


def rolling_std_filled(df: DataFrame, key: str | list[str], t: str, x: str, w: int,
                       name: str = "rolling_std", n: Column | None = None) -> DataFrame:
    """Sample deviation of the last ``w`` points; where too few exist, the key's mean of it.

    ``n`` is the length of the series, if a column has it already.
    """
    frame = along(key, t).rowsBetween(-(w - 1), 0)
    size = F.count("*").over(whole(key)) if n is None else n
    enough = F.count(x).over(frame) >= F.least(F.lit(w), size)
    rolled = df.withColumn("_std", F.when(enough, F.stddev_samp(x).over(frame)))
    return rolled.withColumn(
        name, F.coalesce("_std", F.avg("_std").over(whole(key)))
    ).drop("_std")


def difference(df: DataFrame, key: str, t: str, x: str, d: int = 1, seasonal_d: int = 0,
               s: int = 1, name: str = "diff") -> DataFrame:
    """``d`` ordinary and ``seasonal_d`` seasonal differences; rows without a full history go."""
    out = df.withColumns({name: F.col(x), "_pos": F.row_number().over(along(key, t))})
    for lag in [1] * d + [s] * seasonal_d:
        out = out.withColumn(name, F.col(name) - F.lag(name, lag).over(along(key, t)))
    return out.where(F.col("_pos") > d + seasonal_d * s).drop("_pos")


def t_index(df: DataFrame, key: str, t: str, name: str = "idx") -> DataFrame:
    return df.withColumn(name, F.row_number().over(along(key, t)) - 1)


# --- series: runs, islands, trims, fills --------------------------------------------------


def run_id(df: DataFrame, key: str, t: str, code: str, name: str = "run") -> DataFrame:
    """Number of the run of equal values a row belongs to, from 1."""
    w = along(key, t)
    change = F.when(F.col(code).eqNullSafe(F.lag(code).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    out = df.withColumn("_change", change)
    return out.withColumn(
        name, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_change")


def run_length(df: DataFrame, key: str, t: str, code: str, name: str = "run_length") -> DataFrame:
    out = run_id(df, key, t, code, "_run")
    return out.withColumn(name, F.count("*").over(whole([key, "_run"]))).drop("_run")


def first_of_run(df: DataFrame, key: str, t: str, code: str) -> DataFrame:
    out = df.withColumn("_prev", F.lag(code).over(along(key, t)))
    return out.where(F.col("_prev").isNull() | (F.col("_prev") != F.col(code))).drop("_prev")


def islands(df: DataFrame, keys: list[str], val: str) -> DataFrame:
    """Groups of consecutive integers: first and last value and length, per key."""
    numbered = df.withColumn("_island", F.col(val) - F.row_number().over(along(keys, val)))
    return (
        numbered.groupBy(*keys, "_island")
        .agg(F.min(val).alias("first"), F.max(val).alias("last"), F.count("*").alias("length"))
        .drop("_island")
    )


def consecutive_groups(df: DataFrame, key: str, val: str, long_from: int = 2) -> DataFrame:
    """First value of every group of consecutive integers, and whether the group is long."""
    return islands(df, [key], val).select(
        key, F.col("first").alias(val), (F.col("length") >= long_from).cast("int").alias("is_long")
    )


def trim_leading_zeros(df: DataFrame, key: str, t: str, x: str) -> DataFrame:
    """Rows from the first non-zero value on; a series of zeros stays whole."""
    start = F.min(F.when(F.col(x) != 0, F.col(t))).over(whole(key))
    return df.withColumn("_from", start).where(
        F.col("_from").isNull() | (F.col(t) >= F.col("_from"))
    ).drop("_from")


def trim_trailing_zeros(df: DataFrame, key: str, t: str, x: str) -> DataFrame:
    """Rows up to the last non-zero value; a series of zeros stays whole."""
    stop = F.max(F.when(F.col(x) != 0, F.col(t))).over(whole(key))
    return df.withColumn("_to", stop).where(
        F.col("_to").isNull() | (F.col(t) <= F.col("_to"))
    ).drop("_to")


def edge_filled(key: str | list[str], t: str, x: str) -> Column:
    """Missing values at both ends take the nearest present one."""
    w = along(key, t)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside_or_tail = F.last(x, ignorenulls=True).over(back)
    head = F.first(x, ignorenulls=True).over(full)
    tail = F.max(F.when(F.col(x).isNotNull(), F.col(t))).over(full)
    return F.when(inside_or_tail.isNull(), head).when(F.col(t) > tail, inside_or_tail).otherwise(F.col(x))


def fill_edges(df: DataFrame, key: str, t: str, x: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or x, edge_filled(key, t, x))


def fill_interior(df: DataFrame, key: str, t: str, x: str, name: str | None = None) -> DataFrame:
    """A missing value between two present neighbours becomes their mean."""
    w = along(key, t)
    return df.withColumn(
        name or x, F.coalesce(F.col(x), (F.lag(x).over(w) + F.lead(x).over(w)) / 2)
    )


def dedupe_last(df: DataFrame, keys: list[str], order: str, *carried: str) -> DataFrame:
    """One row per key: the one with the largest ``order`` value, with its other columns."""
    last = F.max(F.struct(order, *carried)).alias("_last")
    return df.groupBy(*keys).agg(last).select(
        *keys, *[F.col(f"_last.{c}").alias(c) for c in (order, *carried)]
    )
