"""Composite jobs: the public entry points."""
from .anomalies import detect_anomalies, series_from_matrix
from .churn import change_types, churn_profile, zero_budget_profile
from .cleaning import clean_cycles
from .mart import build_churn_mart, comment_summary, eligible_masters, transfer_keys
from .matrix import budget_matrix
from .rollup import campaign_rollup, join_rollup, tidy_mart
from .seasonality import detect_cycle_seasonality, detect_series_seasonality

__all__ = [
    "budget_matrix", "build_churn_mart", "campaign_rollup", "change_types", "churn_profile", "clean_cycles",
    "comment_summary", "detect_anomalies", "detect_cycle_seasonality", "detect_series_seasonality",
    "eligible_masters", "join_rollup", "series_from_matrix", "tidy_mart", "transfer_keys",
    "zero_budget_profile",
]
