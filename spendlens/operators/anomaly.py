"""Peaks, decomposition and anomaly rules on series (key, t, x).

All steps are windows over the same key, so after the one shuffle that gathers a series
the whole detector runs in place. ``t`` counts the points of a key from 0 without holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import along, islands, moving_average, rolling_std_filled, run_id, whole

ZERO_FLOOR = 10.0  # fixed value: budgets below this count as zero


def next_marked(col: str, mark: str, key: str, t: str) -> Column:
    """``col`` of the next row of the key at which ``mark`` holds (null: none)."""
    return F.expr(f"lead(if(`{mark}`, {col}, null), 1) ignore nulls over (partition by `{key}` order by `{t}`)")


def mark_extrema(df: DataFrame, key: str, t: str = "t", x: str = "x") -> DataFrame:
    """Add ``is_peak`` and ``is_trough``: strict local extremes, a plateau at its middle
    (rounded down), never at the ends of the series.

    All in the order of the series: the begin of a row's plateau is the last begin up to the row, its end the next end.
    """
    order = along(key, t)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    beside = df.withColumns({"_before": F.lag(x).over(order), "_after": F.lead(x).over(order), "_row": F.row_number().over(order)})
    beside = beside.withColumns({
        "_begins": (F.col("_row") == 1) | ~F.col("_before").eqNullSafe(F.col(x)),
        "_ends": F.lead(F.lit(1)).over(order).isNull() | ~F.col("_after").eqNullSafe(F.col(x)),
    })
    placed = beside.withColumns({
        "_first": F.last(F.when(F.col("_begins"), F.struct(F.col(t).alias("t"), F.col("_before").alias("x"))), ignorenulls=True).over(upto),
        "_next": next_marked(f"struct(`{t}` as t, _after as x)", "_ends", key, t),
    }).withColumn("_last", F.when(F.col("_ends"), F.struct(F.col(t).alias("t"), F.col("_after").alias("x"))).otherwise(F.col("_next")))
    here = F.col(t) == F.floor((F.col("_first.t") + F.col("_last.t")) / 2)
    peak = here & (F.col(x) > F.col("_first.x")) & (F.col(x) > F.col("_last.x"))
    trough = here & (F.col(x) < F.col("_first.x")) & (F.col(x) < F.col("_last.x"))
    return placed.withColumns({
        "is_peak": F.coalesce(peak, F.lit(False)), "is_trough": F.coalesce(trough, F.lit(False)),
    }).drop("_before", "_after", "_row", "_begins", "_ends", "_first", "_next", "_last")


def find_peaks(df: DataFrame, key: str, t: str = "t", x: str = "x", sign: int = 1) -> DataFrame:
    """Rows at the peaks (``sign=-1``: at the troughs)."""
    flag = "is_peak" if sign > 0 else "is_trough"
    return mark_extrema(df, key, t, x).where(flag).drop("is_peak", "is_trough")


def extrema(df: DataFrame, key: str, t: str = "t", x: str = "x") -> DataFrame:
    """Peaks and troughs in time order, numbered from 0."""
    both = mark_extrema(df, key, t, x).where(F.col("is_peak") | F.col("is_trough"))
    return both.withColumn("ordinal", F.row_number().over(along(key, t)) - 1)


def peak_amplitudes(df: DataFrame, key: str, t: str = "t", x: str = "x", w: int = 3) -> DataFrame:
    """Heights of the peaks in order, and their moving average."""
    peaks = find_peaks(df, key, t, x).withColumn("ordinal", F.row_number().over(along(key, t)) - 1)
    return peaks.withColumn("smooth", moving_average(key, "ordinal", x, w)).select(
        key, "ordinal", t, F.col(x).alias("amplitude"), "smooth"
    )


def season_flag(key: str, t: str, period: str, k: float) -> Column:
    """True at a peak whose next peak is at least ``k`` periods away."""
    nxt = next_marked(f"`{t}`", "is_peak", key, t)
    return F.col("is_peak") & ((nxt - F.col(t)) / F.col(period) >= k)


def mark_pauses(df: DataFrame, key: str, period: str = "period", t: str = "t", x: str = "x",
                k: float = 2.0, tail: bool = False, tail_k: float = 2.0) -> DataFrame:
    """Add ``is_late``: a peak followed by a pause of at least ``k`` periods; with ``tail``
    also a last peak at least ``tail_k`` periods from the end."""
    marked = mark_extrema(df, key, t, x).withColumns({
        "_n": F.count("*").over(whole(key)),
        "_next": next_marked(f"`{t}`", "is_peak", key, t),
    })
    late = (F.col("_next") - F.col(t)) / F.col(period) >= k
    if tail:
        late = F.coalesce(late, (F.col("_n") - F.col(t)) / F.col(period) >= tail_k)
    return marked.withColumn("is_late", F.col("is_peak") & F.coalesce(late, F.lit(False))).drop(
        "_n", "_next", "is_peak", "is_trough"
    )


def season_deviation(df: DataFrame, key: str, period: str = "period", t: str = "t", x: str = "x",
                     k: float = 2.0, tail: bool = False, tail_k: float = 2.0) -> DataFrame:
    """Peaks followed by too long a pause: rows (key, t)."""
    return mark_pauses(df, key, period, t, x, k, tail, tail_k).where("is_late").select(key, t)


def decomposition_trend(df: DataFrame, keys: list[str], t: str, x: str, period: str, n: Column | None = None) -> DataFrame:
    """Add ``trend``, missing at the edges, and the columns ``_n`` (length), ``_p`` (period in
    use) and ``_u`` (an order-preserving scale of ``t``).

    The frame of a centred mean of per-key width is a range frame: points within half a
    period are those within 1 on the scale 2t / (2h + 1), never on its border.
    ``n`` is the length of the series, if a column has it already.
    """
    sized = df.withColumn("_n", F.count("*").over(whole(keys)) if n is None else n)
    wanted = F.when(F.col("_n") <= F.col(period), F.col("_n") - 1).otherwise(F.col(period))
    scaled = sized.withColumn("_p", wanted.cast("int"))
    half = F.floor(F.col("_p") / 2)
    scaled = scaled.withColumn("_u", (F.col(t) * 2).cast("double") / (half * 2 + 1))
    frame = Window.partitionBy(*keys).orderBy("_u").rangeBetween(-1, 1)
    total = F.sum(x).over(frame)
    ends = (F.first(x).over(frame) + F.last(x).over(frame)) / 2
    full = F.count("*").over(frame) == half * 2 + 1
    mean = F.when(F.col("_p") % 2 == 0, total - ends).otherwise(total) / F.nullif(F.col("_p"), F.lit(0))
    return scaled.withColumn("trend", F.when(full & (F.col("_p") > 0), mean))


def filled_trend(keys: list[str]) -> Column:
    """``trend`` with its missing ends set to the nearest present value.

    The present values of a trend have no holes, so only its first and last one are needed
    and the window has no order.
    """
    at = F.when(F.col("trend").isNotNull(), F.col("_u"))
    head, tail = (pick("trend", at).over(whole(keys)) for pick in (F.min_by, F.max_by))
    return F.coalesce("trend", F.when(F.col("_u") < F.min(at).over(whole(keys)), head).otherwise(tail))


def decompose(df: DataFrame, key: str, period: str = "period", t: str = "t", x: str = "x") -> DataFrame:
    """Additive decomposition into trend, seasonal and residual, with a period per key.

    The trend is a centred mean (half weights at the ends if the period is even), the
    seasonal part the mean of the detrended values per phase, re-centred on zero.
    """
    parts = decomposition_trend(df, [key], t, x, period)
    phase = whole([key, "_phase"])
    parts = parts.withColumn("_p", F.greatest("_p", F.lit(1)))
    parts = parts.withColumn("_phase", F.col(t) % F.col("_p"))
    parts = parts.withColumn("_mean", F.avg(F.col(x) - F.col("trend")).over(phase))
    # every phase weighs the same, however many points it has
    level = F.sum(F.when(F.col(t) < F.col("_p"), F.col("_mean"))).over(whole(key)) / F.col("_p")
    parts = parts.withColumn("seasonal", F.col("_mean") - level)
    return parts.withColumn("resid", F.col(x) - F.col("trend") - F.col("seasonal")).drop(
        "_n", "_p", "_u", "_phase", "_mean"
    )


def trend_columns(df: DataFrame, keys: list[str], t: str, x: str, period: str, w: int, n: Column | None = None) -> DataFrame:
    """Add ``trend`` (edges filled), ``deviation`` from it and its ``rolling_std``."""
    parts = decomposition_trend(df, keys, t, x, period, n)
    parts = parts.withColumn("trend", filled_trend(keys))
    parts = parts.withColumn("deviation", F.col(x) - F.col("trend"))
    # the order of _u is that of t, and the rows are sorted by it already
    return rolling_std_filled(parts, keys, "_u", "deviation", w, n=F.col("_n")).drop("_n", "_p", "_u")


def deviation_type(threshold: float, prefix: str = "") -> Column:
    over = F.abs("deviation") > threshold * F.abs("rolling_std")
    sign = F.when(F.col("deviation") < 0, prefix + "decrease").otherwise(prefix + "increase")
    return F.when(over, sign)


def deviation_ratio() -> Column:
    """Deviation in units of the rolling deviation; infinite where that is zero."""
    ratio = F.abs(F.try_divide("deviation", "rolling_std"))
    return F.coalesce(ratio, F.lit(float("inf")))


def trend_deviation(df: DataFrame, key: str, period: str = "period", t: str = "t", x: str = "x",
                    threshold: float = 1.5, w: int = 4) -> DataFrame:
    """Points far from the trend: rows (key, t, type, ratio)."""
    long = df.withColumn("_n", F.count("*").over(whole(key))).where(F.col("_n") >= 2)
    flagged = trend_columns(long, [key], t, x, period, w).withColumn("type", deviation_type(threshold))
    return flagged.where(F.col("type").isNotNull()).select(key, t, "type", deviation_ratio().alias("ratio"))


def amplitude_deviation(df: DataFrame, key: str, period: str = "period", t: str = "t", x: str = "x",
                        threshold: float = 1.5, w: int = 4) -> DataFrame:
    """The same rule on the series of extremes: rows (key, t, type, ratio), prefixed ``amp_``."""
    points = extrema(df, key, t, x).withColumn("_n", F.count("*").over(whole(key))).where(F.col("_n") >= 2)
    flagged = trend_columns(points, [key], "ordinal", x, period, w).withColumn(
        "type", deviation_type(threshold, "amp_")
    )
    return flagged.where(F.col("type").isNotNull()).select(key, t, "type", deviation_ratio().alias("ratio"))


def find_zeros(df: DataFrame, key: str, t: str = "t", x: str = "x", floor: float = ZERO_FLOOR) -> DataFrame:
    """Points below the floor."""
    return df.where(F.col(x) < floor).select(key, t, F.lit("zero").alias("type"), F.lit(0.0).alias("ratio"))


def detect_flags(df: DataFrame, key: str, period: str = "period", t: str = "t", x: str = "x",
                 threshold: float = 1.5, w: int = 4, k: float = 2.0, floor: float = ZERO_FLOOR) -> DataFrame:
    """All four rules at once: rows (key, period, t, type, ratio), one per flagged point.

    Each rule adds a column to the series instead of a branch of a union, so the series is
    read once. Where several rules hit one point the last type in alphabetical order wins
    (``zero`` over ``season`` over ``increase`` and so on) with its own ratio.
    """
    # everything in the order of the series first, so that order is made once
    marked = mark_extrema(df, key, t, x).withColumn("is_ext", F.col("is_peak") | F.col("is_trough"))
    ordinal = F.count_if("is_ext").over(along(key, t).rowsBetween(Window.unboundedPreceding, 0)) - 1
    staged = marked.withColumns({"_all": F.count("*").over(whole(key)), "_exts": F.count_if("is_ext").over(whole(key))}).withColumns({
        "_season": season_flag(key, t, period, k), "_ord": F.when(F.col("is_ext"), ordinal).otherwise(F.col(t)),
        # the other points form a group of their own, in their own order and kept cheap by the shortest period
        "_ext_period": F.when(F.col("is_ext"), F.col(period)).otherwise(F.lit(1.0)),
        "_own": F.when(F.col("is_ext"), F.col("_exts")).otherwise(F.col("_all") - F.col("_exts")),
    })
    trended = trend_columns(staged, [key], t, x, period, w, F.col("_all")).withColumn("_trend_hit", F.struct(
        deviation_type(threshold).alias("type"), deviation_ratio().alias("ratio")
    )).drop("trend", "deviation", "rolling_std")
    amped = trend_columns(trended, [key, "is_ext"], "_ord", x, "_ext_period", w, F.col("_own"))
    amp_hit = F.when(F.col("is_ext"), F.struct(
        deviation_type(threshold, "amp_").alias("type"), deviation_ratio().alias("ratio")
    ))
    plain = lambda cond, name: F.when(cond, F.struct(F.lit(name).alias("type"), F.lit(0.0).alias("ratio")))
    hits = F.array(plain(F.col(x) < floor, "zero"), plain(F.col("_season"), "season"), F.col("_trend_hit"), amp_hit)
    valid = F.filter(hits, lambda h: h["type"].isNotNull())
    return amped.withColumn("_win", F.array_max(valid)).where(F.col("_win").isNotNull()).select(
        key, period, t, F.col("_win.type").alias("type"), F.col("_win.ratio").alias("ratio")
    )


def collapse_runs(flags: DataFrame, key: str, t: str = "t", mode: str = "islands", relabel: bool = True,
                  offline_from: int = 2) -> DataFrame:
    """One row per run of the same type: its first point.

    ``islands``: a run is made of consecutive points; a run of zeros of ``offline_from`` or
    more becomes ``offline``. ``adjacent`` is the older rule: neighbours in the list count
    as a run whatever their distance, more than two zeros are ``offline``, and the last flag
    is dropped if the one before it is ``offline``.
    """
    if mode == "adjacent":
        return _collapse_adjacent(flags, key, t)
    runs = islands(flags, [key, "type"], t)
    firsts = flags.join(
        runs.select(key, "type", F.col("first").alias(t), "length"), [key, "type", t]
    )
    if relabel:
        offline = (F.col("type") == "zero") & (F.col("length") >= offline_from)
        firsts = firsts.withColumn("type", F.when(offline, "offline").otherwise(F.col("type")))
    return firsts.drop("length").select(*flags.columns)


def collapse_in_place(flags: DataFrame, key: str, t: str = "t", offline_from: int = 2) -> DataFrame:
    """The ``islands`` rule for flags of which a point has one at most, in the order of the key alone.

    A run begins where the point before has no flag of the same type, and is long enough for ``offline`` if the
    flag ``offline_from - 1`` rows on stands as many points on, and all between have its type.
    """
    order = along(key, t)
    follows = F.coalesce((F.lag(t).over(order) == F.col(t) - 1) & (F.lag("type").over(order) == F.col("type")), F.lit(False))
    long = F.lit(True)
    for i in range(1, offline_from):
        long = long & F.coalesce((F.lead(t, i).over(order) == F.col(t) + i) & (F.lead("type", i).over(order) == F.col("type")), F.lit(False))
    marked = flags.withColumns({"_follows": follows, "_long": long})
    offline = (F.col("type") == "zero") & F.col("_long")
    return marked.where(~F.col("_follows")).withColumn(
        "type", F.when(offline, "offline").otherwise(F.col("type"))).select(*flags.columns)


def _collapse_adjacent(flags: DataFrame, key: str, t: str) -> DataFrame:
    order = along(key, t)
    runs = run_id(flags, key, t, "type", "_run")
    runs = runs.withColumn("_size", F.count("*").over(whole([key, "_run"])))
    offline = (F.col("type") == "zero") & (F.col("_size") > 2)
    coded = runs.withColumn("type", F.when(offline, "offline").otherwise(F.col("type")))
    firsts = coded.withColumn("_prev", F.lag("type").over(order)).where(
        F.col("_prev").isNull() | (F.col("_prev") != F.col("type"))
    )
    kept = firsts.withColumns({
        "_back": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(t))),
        "_count": F.count("*").over(whole(key)),
        "_prev": F.lag("type").over(order),
    })
    trailing = (F.col("_back") == 1) & (F.col("_count") > 2) & (F.coalesce(F.col("_prev"), F.lit("")) == "offline")
    return kept.where(~trailing).select(*flags.columns)
