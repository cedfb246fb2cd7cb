"""Profiles of advertisers that left, and of zero-budget advertisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import exact_sum, unless
from ..operators.joins import keep_keys
from ..operators.positions import keyed_positions
from ..operators.spectral import acf, acf_flag
from ..operators.windows import along

# fixed values: labels of the budget changes of a month
CHANGE_TYPES = ("Change down", "Change up", "Churn", "Idle down", "Idle up", "New", "No change")
TYPE_PAIRS = (
    ("Idle down", "Idle up"), ("Change up", "Change down"), ("Change down", "Idle down"),
    ("Change down", "Idle up"),
)


def active_rows(df: DataFrame, budget: str = "campaign_budget", spend: str = "spend") -> DataFrame:
    """Rows with a budget and with spend; missing amounts stay."""
    return df.where(unless(F.col(budget) == 0) & unless(F.col(spend) == 0))


def churned_rows(df: DataFrame, key: str = "idadvertiser", change: str = "adv_change_type") -> DataFrame:
    """All rows of the advertisers that left at some point."""
    gone = df.where(F.lower(change) == "churn").select(key).distinct()
    return keep_keys(df, gone, key)


def churn_profile(df: DataFrame, key: str = "idadvertiser", change: str = "adv_change_type",
                  dims: tuple = ("advertiser_state", "business_category"),
                  pairs: tuple = TYPE_PAIRS) -> DataFrame:
    """Long table (section, item, keys) about the advertisers that left: how many ever had
    each change type, pairs of types (both, either), their spread over the dimensions, and
    how many keys have more than one value of a dimension."""
    # all sections count keys, so one aggregate per key answers them; its sets hold at most the
    # values of a dimension
    per_key = active_rows(df).where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(F.lower(change) == "churn").alias("_gone"), F.collect_set(change).alias("_types"),
        *[F.collect_set(F.coalesce(F.col(d), F.lit("Other"))).alias(d) for d in dims],
    ).where("_gone")
    had = lambda v: F.array_contains("_types", v)
    tests = [("ever", v, had(v)) for v in CHANGE_TYPES]
    tests += [("both", f"{a} + {b}", had(a) & had(b)) for a, b in pairs]
    tests += [("either", f"{a} + {b}", had(a) | had(b)) for a, b in pairs]
    tests += [("ambiguous", d, F.size(d) > 1) for d in dims]
    line = lambda section, item, n: F.struct(
        F.lit(section).alias("section"), item.alias("item"), n.cast("long").alias("n")
    )
    flags = F.array(*[line(section, F.lit(item), test) for section, item, test in tests])
    spread_of = lambda d: F.transform(d, lambda v: line(d, v, F.lit(1)))
    found = per_key.select(F.inline(F.concat(flags, *[spread_of(d) for d in dims])))
    # the fixed items are listed even if there is no key at all
    zeros = df.sparkSession.range(1).select(
        F.inline(F.array(*[line(section, F.lit(item), F.lit(0)) for section, item, _ in tests]))
    )
    return found.unionByName(zeros).groupBy("section", "item").agg(F.sum("n").alias("keys"))


def change_types(series: DataFrame, key: str, t: str = "t", x: str = "x", grace: int = 1) -> DataFrame:
    """Rows (key, t, budget, previous, change_type): what each month did to an advertiser's budget.

    ``series`` has one row per key and month, zero where nothing was booked. A key starts with ``New`` in its
    first month with a budget. From then on a month with a budget is ``Change up``, ``Change down`` or ``No change``
    against the month before, or ``Idle up`` if that had none. The first month without a budget is ``Idle down``; the month in which more
    than ``grace`` months have passed without one is ``Churn``. Further idle months, and those before the first budget,
    have no row. Null values count as zero, rows without a key are left out; a key without any budget has no row.
    """
    order = along(key, t)
    spent = F.coalesce(F.col(x), F.lit(0.0))
    active = F.when(spent > 0, F.col(t))
    seen = series.where(F.col(key).isNotNull()).select(key, t, spent.alias("budget"), active.alias("_active")).withColumns({
        "previous": F.lag("budget").over(order), "_last": F.last("_active", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    })
    idle = F.col(t) - F.col("_last")
    kind = (
        F.when(F.col("_active").isNotNull(), F.when(F.col("_last").isNull(), "New").when(F.col("previous") <= 0, "Idle up")
               .when(F.col("budget") > F.col("previous"), "Change up").when(F.col("budget") < F.col("previous"), "Change down").otherwise("No change"))
        .when(idle == 1, "Idle down").when(idle == grace + 1, "Churn")
    )
    return seen.withColumn("change_type", kind).where(F.col("change_type").isNotNull()).select(key, t, "budget", "previous", "change_type")


def zero_budget_profile(df: DataFrame, key: str, budget: str, order: list[str],
                        nlags: int | None = None, mode: str = "band") -> DataFrame:
    """Rows (key, n, lags, flag): advertisers with a zero budget somewhere, but not in total,
    and whether their budgets repeat by autocorrelation, at any lag unless ``nlags`` is given.

    Cycles are numbered across the whole table and cut into blocks of time, so an
    advertiser with any number of cycles is spread over tasks.
    """
    zero = F.max((F.col(budget) == 0).cast("int")) == 1
    tested = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        zero.alias("_zero"), exact_sum(F.col(budget)).alias("_total")
    ).where(F.col("_zero") & (F.col("_total") != 0))
    series = keyed_positions(
        keep_keys(df, tested, key).select(key, *order, F.col(budget).alias("x")), key, order, "t"
    )
    return acf_flag(acf(series, key, "t", "x", nlags), key, mode)
