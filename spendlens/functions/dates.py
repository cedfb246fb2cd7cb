"""Calendar expressions. Buckets are half-open ``[start, next)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS_IN = {"month": 1, "quarter": 3, "year": 12}


def _per_year(grain: str) -> int:
    if grain not in MONTHS_IN:
        raise ValueError(f"grain must be one of {sorted(MONTHS_IN)}, not {grain!r}")
    return 12 // MONTHS_IN[grain]


def parse_date(col: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to date; text that does not fit becomes null."""
    return F.try_to_timestamp(col, F.lit(fmt)).cast("date")


def year_month(year: Column, month: Column) -> Column:
    """``year * 100 + month``."""
    return year * 100 + month


def month_gap(end: Column, start: Column) -> Column:
    """Whole calendar months from ``start`` to ``end``, by month number."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def day_gap(end: Column, start: Column) -> Column:
    """Whole days from ``start`` to ``end``; floors, so timestamps keep their sign."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.floor(seconds / 86400)


def bucket_index(date: Column, grain: str) -> Column:
    """Consecutive number of the calendar bucket that holds ``date``."""
    n, size = _per_year(grain), MONTHS_IN[grain]
    return F.year(date) * n + F.floor((F.month(date) - 1) / size).cast("int")


def bucket_start(index: Column, grain: str) -> Column:
    """First day of a bucket."""
    n, size = _per_year(grain), MONTHS_IN[grain]
    year = F.floor(index / n).cast("int")
    return F.make_date(year, (index - year * n) * size + 1, F.lit(1))


def bucket_days(index: Column, grain: str) -> Column:
    """Length of a bucket in days."""
    return F.datediff(bucket_start(index + 1, grain), bucket_start(index, grain))


def bucket_label(index: Column, grain: str) -> Column:
    """``2009-Q1``, ``2009-M1`` or ``2009``."""
    n = _per_year(grain)
    year = F.floor(index / n).cast("int")
    if grain == "year":
        return year.cast("string")
    mark = "-Q" if grain == "quarter" else "-M"
    return F.concat(year.cast("string"), F.lit(mark), (index - year * n + 1).cast("int").cast("string"))


def label_of(index: int, grain: str) -> str:
    """Driver-side twin of :func:`bucket_label`, for column names."""
    n = _per_year(grain)
    year, part = divmod(index, n)
    if grain == "year":
        return str(year)
    return f"{year}-{'Q' if grain == 'quarter' else 'M'}{part + 1}"
