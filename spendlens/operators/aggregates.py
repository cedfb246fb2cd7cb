"""Grouped aggregates and profiles.

Everything here combines on the map side. Where a single group could grow with the
data (a mode, exact quartiles), the values are counted first or bracketed by a sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import exact_avg, exact_sum
from .keyed import aggregate_apart

QUARTILES = (0.25, 0.5, 0.75)


def numeric_names(df: DataFrame, skip: tuple = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def sum_by(df: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    """Exact money total per key; missing keys form no group."""
    return df.dropna(subset=keys).groupBy(*keys).agg(exact_sum(F.col(col)).alias(name))


def mean_all(df: DataFrame, key: str, money: tuple = ()) -> DataFrame:
    """Mean of every numeric column per key; ``money`` columns are added as whole cents."""
    cols = numeric_names(df, (key,))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[
        (exact_avg(F.col(c)) if c in money else F.avg(c)).alias(c) for c in cols
    ])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Values by falling count; missing values are not counted."""
    return (
        df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc(col))
    )


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    return value_counts(df, col).limit(k)


def mode_of(df: DataFrame, col: str) -> DataFrame:
    """One row with the most frequent value, the smallest among equals."""
    return top_k(df, col, 1).select(col)


def exact_quantiles(df: DataFrame, cols: list[str], probs: tuple = QUARTILES,
                    accuracy: int = 10_000, slots: int = 1024) -> DataFrame:
    """Exact quantiles with linear interpolation: rows (column, prob, value).

    ``percentile`` keeps all distinct values of a group in one buffer, which cannot hold
    at scale. Instead a mergeable sketch brackets each quantile; a second pass counts the
    rows below the bracket as one number and keeps value counts inside it only. Those are
    ranked in two steps, by ``slots`` equal parts of the bracket and then inside the part
    that holds the rank, so no task sorts a whole bracket.
    """
    long = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
        ])).alias("e")
    ).select("e.column", "e.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    slack = 4.0 / accuracy
    edges = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    sketch = long.groupBy("column").agg(
        F.count("*").alias("n"), F.percentile_approx("value", edges, accuracy).alias("edge")
    )
    k = len(probs)
    brackets = sketch.select(
        "column",
        F.explode(F.array(*[
            F.struct(
                F.lit(p).alias("prob"), F.col("edge")[i].alias("low"), F.col("edge")[k + i].alias("high"),
                ((F.col("n") - 1) * F.lit(p)).alias("rank"),
            ) for i, p in enumerate(probs)
        ])).alias("b"),
    ).select("column", "b.*")
    v = F.when(F.col("value") >= F.col("low"), F.col("value"))
    width = (F.col("high") - F.col("low")) / slots
    slot = F.when(v.isNull(), -1).when(width > 0, F.floor((v - F.col("low")) / width)).otherwise(0)
    inside = (
        long.join(F.broadcast(brackets), "column")  # columns x probs rows
        .where(F.col("value") <= F.col("high"))
        .groupBy("column", "prob", "rank", slot.alias("slot"), v.alias("v"))
        .agg(F.count("*").alias("n"))
    )
    group = ["column", "prob", "rank"]
    totals = inside.groupBy(*group, "slot").agg(F.sum("n").alias("_n"))
    upto = Window.partitionBy(*group).orderBy("slot")
    placed = totals.withColumn("_end", F.sum("_n").over(upto)).withColumn("_start", F.col("_end") - F.col("_n"))
    base = F.floor("rank")
    holding = placed.where((F.col("_start") <= base + 1) & (F.col("_end") > base)).drop("_n", "_end")
    within = Window.partitionBy(*group, "slot").orderBy(F.asc_nulls_first("v"))
    ranked = inside.join(holding, [*group, "slot"]).withColumn("seen", F.col("_start") + F.sum("n").over(within))
    at = lambda r: F.min_by("v", F.when(F.col("seen") > r, F.col("seen")))
    found = ranked.groupBy(*group).agg(at(base).alias("lo"), at(base + 1).alias("hi"))
    weight = F.col("rank") - F.floor("rank")
    value = F.when(weight == 0, F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * weight)
    return found.select("column", "prob", value.alias("value"))


def profile(df: DataFrame, cols: list[str] | None = None, money: tuple = ()) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum, one row per column.

    Means of ``money`` columns are taken from totals in whole cents.
    """
    cols = cols or numeric_names(df)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("e")).select("e.*")
    plain = F.avg("value")
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"),
        (F.coalesce(exact_avg(F.when(F.col("column").isin(*money), F.col("value"))), plain) if money else plain).alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    marks = exact_quantiles(df, cols).groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{int(p * 100)}") for p in QUARTILES
    ])
    return basic.join(marks, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def _per_column(df: DataFrame, test, name: str) -> DataFrame:
    counts = df.agg(*[F.count_if(test(F.col(c))).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", name)


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column."""
    return _per_column(df, lambda c: c.isNull(), "missing")


def marker_profile(df: DataFrame, marker: str) -> DataFrame:
    """Occurrences of a marker text per column."""
    return _per_column(df, lambda c: c.cast("string") == marker, "marked")


def keys_per_dim(df: DataFrame, key: str, dim: str) -> DataFrame:
    """Distinct keys seen with each value of a dimension."""
    return (
        df.where(F.col(key).isNotNull() & F.col(dim).isNotNull())
        .groupBy(dim).agg(F.countDistinct(key).alias("keys"))
    )


def ambiguous_keys(df: DataFrame, key: str, dim: str) -> DataFrame:
    """Keys seen with more than one value of a dimension."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(dim).alias("values"))
        .where(F.col("values") > 1)
    )


def ever_flags(df: DataFrame, key: str, dim: str, values: list[str]) -> DataFrame:
    """One row per key with a 0/1 column for each listed value it ever had."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[
        F.max(F.when(F.lower(F.col(dim)) == v.lower(), 1).otherwise(0)).alias(v) for v in values
    ])


def ever_counts(df: DataFrame, key: str, dim: str, values: list[str]) -> DataFrame:
    """How many keys ever had each value."""
    flags = ever_flags(df, key, dim, values)
    return flags.agg(*[F.sum(v).alias(v) for v in values]).unpivot([], values, dim, "keys")


def cooccurrence(df: DataFrame, key: str, dim: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """For each listed pair, how many keys had both values, and how many had either."""
    values = sorted({v for pair in pairs for v in pair})
    flags = ever_flags(df, key, dim, values)
    both = [F.sum(F.col(a) * F.col(b)).alias(f"both_{i}") for i, (a, b) in enumerate(pairs)]
    either = [F.sum(F.greatest(a, b)).alias(f"either_{i}") for i, (a, b) in enumerate(pairs)]
    row = flags.agg(*both, *either)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"),
                 F.col(f"both_{i}").alias("both"), F.col(f"either_{i}").alias("either"))
        for i, (a, b) in enumerate(pairs)
    ])).alias("p")).select("p.*")


def key_share(df: DataFrame, key: str, cond: Column) -> DataFrame:
    """Percentage of keys with at least one row that meets the condition."""
    return df.agg(
        F.countDistinct(F.when(cond, F.col(key))).alias("keys_hit"), F.countDistinct(key).alias("keys"),
    ).withColumn("percent", F.lit(100.0) * F.col("keys_hit") / F.col("keys"))


def zero_total_keys(df: DataFrame, key: str, col: str) -> DataFrame:
    """Keys that hold a zero somewhere and add up to zero."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.max((F.col(col) == 0).cast("int")).alias("_zero"), exact_sum(F.col(col)).alias("total"))
        .where((F.col("_zero") == 1) & (F.col("total") == 0)).select(key)
    )


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the extremes; the last bin holds the maximum."""
    present = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    span = present.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("s")).scalar()
    lo, width = span["lo"], (span["hi"] - span["lo"]) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return present.groupBy(slot.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def series_std(df: DataFrame, key: str, col: str) -> DataFrame:
    """Population and sample deviation per key."""
    return df.groupBy(key).agg(
        F.stddev_pop(col).alias("std_pop"), F.stddev_samp(col).alias("std_samp")
    )


def argmax(df: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Largest value per key and its first position."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(at)).alias("p"))).alias("m")
    return df.groupBy(key).agg(best).select(
        key, (-F.col("m.p")).alias(at), F.col("m.v").alias(value)
    )


def count_outliers(df: DataFrame, key: str, col: str, c: float = 2.0) -> DataFrame:
    """Rows per key whose size is at or above mean + c * population deviation.

    The second grouping is by a copy of the key. Grouping by the join key itself would tie
    the count to the join's partitions and keep a hot key from being split there.
    """
    stats = aggregate_apart(df, [key], F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    over = F.abs(col) >= F.col("_m") + c * F.col("_s")
    counted = df.join(stats, key).groupBy(F.struct(key).alias("_k")).agg(F.count_if(over).alias("outliers"))
    return counted.select(f"_k.{key}", "outliers")


def first_by(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """Columns of the earliest row of every key."""
    first = F.min(F.struct(*order, *[c for c in cols if c not in order])).alias("_f")
    return df.groupBy(key).agg(first).select(key, *[F.col(f"_f.{c}").alias(c) for c in cols])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once: empty if they form a primary key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def shape(df: DataFrame) -> DataFrame:
    """Row and column counts, as a table."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))
