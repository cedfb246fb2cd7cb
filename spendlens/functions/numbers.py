"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_PERIOD = 1000  # fixed value: period reported when the strongest bin is the constant term


def cents(col: Column) -> Column:
    """Money as whole cents, so that sums do not depend on the order of addition."""
    return F.floor(col * 100 + 0.5)


def exact_sum(col: Column) -> Column:
    """Sum of a money column; nothing but nulls adds up to zero."""
    return F.coalesce(F.sum(cents(col)), F.lit(0)) / F.lit(100.0)


def exact_avg(col: Column) -> Column:
    """Mean of a money column: exact total, one division."""
    return F.sum(cents(col)) / F.lit(100.0) / F.count(col)


def clamp0(col: Column) -> Column:
    """Negative becomes zero; null stays null."""
    return F.when(col < 0, F.lit(0.0)).otherwise(col)


def unless(cond: Column) -> Column:
    """Not ``cond``, where an unknown condition counts as false (rows with missing stay)."""
    return F.coalesce(~cond, F.lit(True))


def next_pow2(n: Column) -> Column:
    """Smallest power of two that is at least ``n``."""
    bits = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    return F.pow(F.lit(2.0), bits).cast("int")


def rescale(x: Column, low: Column, high: Column) -> Column:
    """Map ``[low, high]`` to 0..1; a constant range has no scale and gives null."""
    return F.when(high > low, (x - low) / (high - low))


def bin_frequency(bin_: Column, nfft: Column) -> Column:
    """Frequency of a bin on a grid of nfft/2 points that spans 0 .. 1/2 inclusive."""
    half = nfft / 2
    return F.when(half > 1, bin_ * (half / (half - 1)) / nfft).otherwise(F.lit(0.0))


def bin_period(bin_: Column, nfft: Column, grid: str = "span") -> Column:
    """Period of a bin; null for the constant term.

    ``span`` is the inverse of :func:`bin_frequency`; ``exact`` uses nfft/bin.
    """
    top = nfft.cast("double") if grid == "exact" else (nfft - 2).cast("double")
    return F.when(bin_ > 0, top / bin_)


def dominant(bin_: Column, nfft: Column, variant: str = "ceil") -> Column:
    """Period of the strongest bin, in one of the three published conventions."""
    period = bin_period(bin_, nfft)
    if variant == "ceil":
        # rounding first: a quotient such as 62/31 must not be lifted by its last bit
        return F.coalesce(F.ceil(F.round(period, 9)).cast("double"), F.lit(float(NO_PERIOD)))
    if variant not in ("raw", "nodc"):
        raise ValueError(f"unknown variant {variant!r}")
    return F.coalesce(period, F.lit(float("inf")))
