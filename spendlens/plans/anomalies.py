"""Period and anomalies of every series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import dominant
from ..operators.anomaly import ZERO_FLOOR, collapse_in_place, collapse_runs, detect_flags, mark_pauses
from ..operators.buckets import to_series
from ..operators.grouped import lowess_deviation
from ..operators.spectral import array_nfft, half_power, series_arrays, strongest_bin


def series_from_matrix(matrix: DataFrame, key: str) -> DataFrame:
    """Series (key, t, x) of a wide matrix, columns in their given order."""
    return to_series(matrix, key, [c for c in matrix.columns if c != key])


def trimmed_with_period(df: DataFrame, key: str, t: str = "t", x: str = "x", w: int = 4,
                        variant: str = "ceil") -> DataFrame:
    """Series without leading zeros, recounted from 0, with the dominant period of the part
    before the trailing zeros: rows (key, idx, x, period).

    The series is gathered once; it is trimmed and its period found on the array, which is
    then unfolded again, so the period needs no join.
    """
    # one step per column: an expression used twice is then computed once
    used = series_arrays(df, key, t, x).withColumn("_used", F.transform("xs", lambda v: v != 0))
    ends = used.select(key, "xs", *[
        F.greatest(F.array_position(flags, F.lit(True)), F.lit(1)).cast("int").alias(name)
        for name, flags in (("_lead", F.col("_used")), ("_tail", F.reverse("_used")))
    ])
    n = F.size("xs")
    cut = ends.select(key, F.slice("xs", F.col("_lead"), n).alias("_body"),
                      F.slice("xs", F.col("_lead"), n - F.col("_tail") - F.col("_lead") + 2).alias("_core"))
    found = cut.select(key, "_body", array_nfft(F.col("_core")).alias("_nfft"),
                       half_power(F.col("_core"), w).alias("_ps"))
    found = found.withColumn("_bin", strongest_bin(F.col("_ps"), 1 if variant == "nodc" else 0))
    return found.select(
        key, dominant(F.col("_bin"), F.col("_nfft"), variant).alias("period"),
        F.posexplode("_body").alias("idx", "x"),
    ).select(key, "idx", "x", "period")


def detect_anomalies(df: DataFrame, key: str, t: str = "t", x: str = "x", w: int = 4, threshold: float = 1.5,
                     floor: float = ZERO_FLOOR, method: str = "decomposition") -> DataFrame:
    """Rows (key, period, idx, type, ratio); ``idx`` counts from the first non-zero point.

    ``decomposition`` is the current detector. ``adjacent`` is its predecessor, which joins
    neighbouring flags of one type whatever their distance. ``lowess`` and
    ``lowess_signal`` are the first generation: long pauses between peaks (also at the end)
    and a local regression of the trend; ``lowess_signal`` keeps the first of consecutive points.
    """
    series = trimmed_with_period(df, key, t, x, w)
    if method.startswith("lowess"):
        return _lowess_flags(series, key, threshold, "signal" if method.endswith("signal") else "trend")
    flags = detect_flags(series, key, "period", "idx", "x", threshold, w, 2.0, floor)
    if method == "adjacent":
        kept = collapse_runs(flags, key, "idx", mode="adjacent")
    else:
        kept = collapse_in_place(flags, key, "idx")
    return kept.select(key, "period", "idx", "type", "ratio")


def _lowess_flags(series: DataFrame, key: str, threshold: float, against: str) -> DataFrame:
    """Both rules flag points of one series, so each becomes a column and no union is needed."""
    k = 2.0 if against == "trend" else 1.5
    marked = mark_pauses(series, key, "period", "idx", "x", k=k, tail=True)
    off = lowess_deviation(marked, key, "period", "idx", "x", threshold=threshold, against=against,
                           keep=("period", "is_late"))
    flags = off.where((F.col("flag") == 1) | F.col("is_late")).select(
        key, "period", F.col("t").cast("int").alias("idx"), F.lit("deviation").alias("type"),
        F.lit(0.0).alias("ratio"),
    )
    return collapse_in_place(flags, key, "idx") if against == "signal" else flags


def anomaly_lists(anomalies: DataFrame, key: str) -> DataFrame:
    """One row per key with parallel arrays of index, type and ratio."""
    packed = F.array_sort(F.collect_list(F.struct("idx", "type", "ratio")))
    folded = anomalies.groupBy(key).agg(F.max("period").alias("period"), packed.alias("_a"))
    return folded.select(
        key, "period", F.col("_a.idx").alias("flags"), F.col("_a.type").alias("types"),
        F.col("_a.ratio").alias("ratios"),
    )
