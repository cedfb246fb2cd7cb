"""Tidying of the mart export, campaign roll-up and its join to the cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import unless
from ..functions.text import strip_suffix_names
from ..operators.clean import drop_marker_rows, promote_numeric
from ..operators.joins import left_join

ROLLUP_KEYS = ("idadvertiser", "idcampaign_master", "idcampaign", "advertiser_city", "advertiser_state",
               "product")
ROLLUP_SUMS = ("clicks", "calls", "impressions", "qualified_calls", "emails", "cvt", "qualified_web_events",
               "stop_request", "businessuser", "system")


def tidy_mart(raw: DataFrame, suffix: str = "_varchar", numeric: list[str] | None = None) -> DataFrame:
    """Rows without the null marker, numbers as numbers, plain column names.

    With ``numeric``, the plain names of the columns that are numbers, the source is read once.
    """
    return promote_numeric(drop_marker_rows(strip_suffix_names(raw, suffix)), numeric)


def campaign_rollup(mart: DataFrame, keys: tuple = ROLLUP_KEYS, sums: tuple = ROLLUP_SUMS,
                    largest: str = "advtrans") -> DataFrame:
    """Counters per campaign over all months; rows with a missing key are left out."""
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    return mart.dropna(subset=list(keys)).groupBy(*keys).agg(*totals, F.max(largest).alias(largest))


def join_rollup(cycles: DataFrame, rolled: DataFrame, budget: str = "budget", null_safe: bool = True) -> DataFrame:
    """Cycles with a budget, each with the counters of its campaign where there are any."""
    keys = ["idadvertiser", "idcampaign_master", "idcampaign"]
    return left_join(cycles.where(unless(F.col(budget) == 0)), rolled, keys, null_safe)
