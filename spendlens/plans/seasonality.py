"""Seasonal or not, and with which period, for every key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spectral import (
    detrended_spectrum, gap_arrays, gap_intervals, ks_uniform, seasonal_slope_of_arrays, series_arrays,
)


def detect_series_seasonality(df: DataFrame, key: str, t: str = "t", x: str = "x", w: int = 4,
                              threshold: float = 0.001, test: str = "slope") -> DataFrame:
    """Rows (key, seasonal, period, slope) for series such as matrix rows.

    ``slope`` tests the regression of power on period, ``ks`` the distance of the powers
    from a uniform law. Keys without a spectrum are not seasonal.
    """
    if test == "slope":
        return seasonal_slope_of_arrays(series_arrays(df, key, t, x), key, "xs", w, threshold)
    tested = ks_uniform(detrended_spectrum(df, key, t, x, w, flat=True), key)
    period = F.when(F.col("seasonal") == 1, (F.col("nfft") - 2) / F.nullif(F.col("bin"), F.lit(0)))
    return tested.select(
        key, F.coalesce("seasonal", F.lit(0)).alias("seasonal"),
        F.coalesce(period, F.lit(0.0)).alias("period"), F.lit(0.0).alias("slope"),
    )


def detect_cycle_seasonality(df: DataFrame, key: str, start: str = "started", end: str = "ended",
                             id_: str = "cycle_id", w: int = 4, threshold: float = 0.001,
                             mode: str = "exact") -> DataFrame:
    """Rows (key, seasonal, period, slope) from raw cycles by way of their gap series.

    Keys with fewer than ``w`` cycles are not tested.
    """
    spans = gap_intervals(df, key, start, end, id_, mode)
    arrays = gap_arrays(spans, mode).select(key, F.when(F.col("cycles") >= w, F.col("xs")).alias("xs"))
    return seasonal_slope_of_arrays(arrays, key, "xs", w, threshold)
