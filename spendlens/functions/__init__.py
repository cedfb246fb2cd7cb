"""Column expressions shared by the operators."""
from .dates import (
    bucket_days, bucket_index, bucket_label, bucket_start, day_gap, month_gap, parse_date,
    year_month,
)
from .numbers import (
    bin_frequency, bin_period, cents, clamp0, dominant, exact_avg, exact_sum, next_pow2, rescale,
    unless,
)
from .text import recode, strip_suffix_names

__all__ = [
    "bin_frequency", "bin_period", "bucket_days", "bucket_index", "bucket_label",
    "bucket_start", "cents", "clamp0", "day_gap", "dominant", "exact_avg", "exact_sum",
    "month_gap", "next_pow2", "parse_date", "recode", "rescale", "strip_suffix_names", "unless",
    "year_month",
]
