"""Filters, repairs and imputation on cycle rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import day_gap, parse_date
from ..functions.numbers import unless
from .aggregates import mode_of
from .keyed import aggregate_apart

NULL_MARK = "\\N"  # fixed value: how the export writes a missing field


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def drop_marker_rows(df: DataFrame, marker: str = NULL_MARK) -> DataFrame:
    """Drop every row with the marker in any text column; missing text is no marker."""
    for name in string_columns(df):
        df = df.where(unless(F.col(name) == marker))
    return df


def castable_columns(df: DataFrame) -> list[str]:
    """Text columns in which every present value reads as a number (one pass, one row)."""
    names = string_columns(df)
    if not names:
        return []
    tests = [
        F.bool_and(F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()).alias(c) for c in names
    ]
    row = df.agg(*tests).first()
    return [c for c in names if row[c]]


def promote_numeric(df: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Turn text columns into numbers where all of their values allow it.

    ``known`` names the columns that are numbers, which saves the pass over the data that finds them.
    """
    return df.withColumns({c: F.col(c).try_cast("double") for c in (castable_columns(df) if known is None else known)})


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Replace missing values by a literal, per column."""
    return df.na.fill(values)


def fill_mode(df: DataFrame, col: str, mode: Column | None = None) -> DataFrame:
    """Replace missing values by the most frequent one (the smallest, if several are).

    ``mode`` takes a value that is known already, such as a scalar subquery.
    """
    return df.withColumn(col, F.coalesce(F.col(col), mode_of(df, col).scalar() if mode is None else mode))


def fill_end_date(df: DataFrame, start: str = "started", end: str = "ended",
                  duration: str = "duration", mode: Column | None = None) -> DataFrame:
    """Rebuild a missing end date from the start and the most frequent duration."""
    usual = mode_of(df, duration).scalar() if mode is None else mode
    return df.withColumn(
        end, F.coalesce(F.col(end), F.date_add(F.col(start), usual.cast("int")))
    )


def fill_group_mean(df: DataFrame, key: str, col: str, when: Column | None = None) -> DataFrame:
    """Replace missing values by the mean of the key, where ``when`` holds.

    The mean is aggregated before anything is shuffled and joined back on the key, so a
    key with a large share of the rows can still be split between tasks.
    """
    means = aggregate_apart(df.where(F.col(key).isNotNull()), [key], F.avg(col).alias("_mean"))
    gap = F.col(col).isNull() & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
    return (
        df.join(means, key, "left")
        .withColumn(col, F.when(gap, F.col("_mean")).otherwise(F.col(col)))
        .select(*df.columns)
    )


def order_dates(df: DataFrame, start: str = "started", end: str = "ended") -> DataFrame:
    """Swap start and end where they are reversed; a missing side is left alone."""
    both = F.col(start).isNotNull() & F.col(end).isNotNull()
    return df.withColumns({
        start: F.when(both, F.least(start, end)).otherwise(F.col(start)),
        end: F.when(both, F.greatest(start, end)).otherwise(F.col(end)),
    })


def drop_on_date(df: DataFrame, col: str, date: str) -> DataFrame:
    """Drop rows on one date; rows without a date stay."""
    return df.where(unless(F.col(col) == F.lit(date).cast("date")))


def parse_dates(df: DataFrame, *cols: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    return df.withColumns({c: parse_date(F.col(c), fmt) for c in cols})


def with_duration(df: DataFrame, start: str = "started", end: str = "ended",
                  name: str = "duration") -> DataFrame:
    return df.withColumn(name, day_gap(F.col(end), F.col(start)))


def replace_where(df: DataFrame, col: str, mask: Column, new: Column) -> DataFrame:
    """Overwrite a column where the mask holds."""
    return df.withColumn(col, F.when(mask, new).otherwise(F.col(col)))


def co_missing(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether two columns are missing together: the three counts and a flag."""
    return df.agg(
        F.count_if(F.col(a).isNull()).alias("missing_a"),
        F.count_if(F.col(b).isNull()).alias("missing_b"),
        F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias("missing_both"),
    ).withColumn("together", (F.col("missing_both") == F.col("missing_a")).cast("long"))


def equal_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many rows hold the same value in both columns, and whether all do."""
    same = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(same).alias("n_equal"),
    ).withColumn("all_equal", (F.col("n_equal") == F.col("n_rows")).cast("long"))


def draw(key: Column, seed: int) -> Column:
    """A number of 32 hex digits that the key and the seed decide, whatever the partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """All rows of ``n`` keys drawn without replacement; the seed fixes the draw."""
    drawn = (
        df.select(key).where(F.col(key).isNotNull()).distinct()
        .orderBy(draw(F.col(key), seed), F.col(key)).limit(n)
    )
    return df.join(drawn, key, "left_semi")


def sample_rows(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About ``share`` of the rows: those whose draw by the row key lies below it.

    A filter without shuffle or state: the same rows in every run and on any cluster, and samples of
    a smaller share lie in those of a larger one. Rows without a key are left out.
    """
    limit = round(share * 16**8)
    if limit >= 16**8:
        return df.where(F.col(key).isNotNull())
    return df.where(F.substring(draw(F.col(key), seed), 1, 8) < F.lit(f"{limit:08x}"))
