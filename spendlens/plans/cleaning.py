"""Cleaning of cycle rows before any time analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import unless
from ..operators.clean import fill_end_date, fill_mode, order_dates, with_duration
from ..operators.joins import drop_keys


def clean_cycles(df: DataFrame, cutoff: str, key: str = "master_id", offer: str = "offer_name",
                 budget: str = "budget", start: str = "started", end: str = "ended",
                 unused: tuple = ()) -> DataFrame:
    """Usable cycles with a duration.

    Advertisers with a missing offer go as a whole; reversed dates are swapped; budgets
    below 1 and starts on the cut-off day go; advertisers with a missing start go as a
    whole; a missing duration becomes the most frequent one and rebuilds the end.
    """
    ordered = with_duration(order_dates(df.drop(*unused), start, end), start, end)
    usable = unless(F.col(budget) < 1) & unless(F.col(start) == F.lit(cutoff).cast("date"))
    # both exclusions in one list: one aggregation and one join on the advertiser
    bad = F.col(offer).isNull() | (usable & F.col(start).isNull())
    listed = ordered.where(bad & F.col(key).isNotNull()).select(key)
    kept = drop_keys(ordered.where(usable), listed, key)
    # the most frequent duration of the rows kept, from counts per key: the rows themselves are joined once
    counts = ordered.where(usable & F.col("duration").isNotNull()).groupBy(key, "duration").agg(F.count("*").alias("_n"))
    usual = drop_keys(counts, listed, key).groupBy("duration").agg(F.sum("_n").alias("_n")) \
        .orderBy(F.desc("_n"), F.asc("duration")).limit(1).select("duration").scalar()
    return fill_mode(fill_end_date(kept, start, end, mode=usual), "duration", usual)
