"""Gap series, power spectra, periods, and tests on them.

A series is bounded by its calendar, so the values of one key fit an array. The Fourier
transform has no built-in; it runs on whole Arrow batches, all series of one length at a
time. Everything before and after it is built from column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import bin_frequency, bin_period, dominant, next_pow2
from .keyed import aggregate_apart
from .windows import along, start_days, whole

CELLS = 1 << 20  # values that one stack of transforms may hold
TIE_DIGITS = 9  # powers that agree to this many places count as equal; the lower bin wins


def gap_intervals(df: DataFrame, key: str, start: str = "started", end: str = "ended",
                  id_: str = "cycle_id", mode: str = "exact") -> DataFrame:
    """Per key: number of cycles, length of the series in days, and its gaps as intervals.

    ``exact`` puts a gap where it happened, between the previous end and the next start;
    ``legacy`` puts it after the cycle that follows it. Dates must be in order.
    """
    days = start_days(df, key, start, end)
    # only the first cycle of a day can begin after a gap: those behind it follow an end that is not before their start
    gap = F.datediff(start, "prev_end")
    lo = F.datediff("prev_end", "first_start") if mode == "exact" else F.datediff("first_end", "first_start")
    pieces = F.collect_list(F.when(gap > 0, F.struct(lo.alias("lo"), (lo + gap).alias("hi"))))
    return days.groupBy(key).agg(
        F.sum("copies").alias("cycles"),
        F.max_by(F.datediff("last_end", "first_start"), F.col(start)).alias("length"),
        F.array_sort(pieces).alias("gaps"),
    )


def gap_arrays(spans: DataFrame, mode: str = "exact", name: str = "xs") -> DataFrame:
    """Add the 0/1 values of a gap series to rows of :func:`gap_intervals` of the same ``mode``."""
    if mode == "legacy":  # intervals may overlap and run past the end; a step of its own, as the array refers to it often
        spans = spans.withColumn("gaps", _merged_gaps())
    # gaps follow each other without overlap: lay down ones up to each, then its zeros
    before = lambda i: F.when(i > 0, F.col("gaps")[F.greatest(i - 1, F.lit(0))]["hi"]).otherwise(0)
    pieces = F.transform("gaps", lambda g, i: F.concat(
        F.array_repeat(F.lit(1.0), g["lo"] - before(i)), F.array_repeat(F.lit(0.0), g["hi"] - g["lo"])
    ))
    tail = F.array_repeat(F.lit(1.0), F.col("length") - _last_end(F.col("gaps")))
    return spans.withColumn(name, F.concat(F.flatten(pieces), tail))


def _last_end(gaps: Column) -> Column:
    return F.coalesce(F.try_element_at(gaps, F.lit(-1))["hi"], F.lit(0))


def _merged_gaps() -> Column:
    """The sorted ``gaps`` inside 0 .. ``length``, each without the days of those before it."""

    def add(done, g):
        lo, hi = F.greatest(g["lo"], _last_end(done)), F.least(g["hi"], F.col("length"))
        return F.when(lo < hi, F.concat(done, F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))).otherwise(done)

    return F.aggregate("gaps", F.array().cast("array<struct<lo:int,hi:int>>"), add)


def gap_series(df: DataFrame, key: str, start: str = "started", end: str = "ended",
               id_: str = "cycle_id", mode: str = "exact") -> DataFrame:
    """Rows (key, t, x): 1 on days covered by a cycle, 0 in the gaps between cycles."""
    spans = gap_intervals(df, key, start, end, id_, mode)
    return gap_arrays(spans, mode).select(key, F.posexplode("xs").alias("t", "x"))


def activity_series(df: DataFrame, key: str, slot: Column, name: str = "t") -> DataFrame:
    """0/1 series over consecutive slots (hours, days), from a key's first to its last one."""
    seen = df.select(key, slot.alias("_s")).distinct()
    spans = seen.groupBy(key).agg(F.collect_list("_s").alias("_have"), F.min("_s").alias("_lo"),
                                  F.max("_s").alias("_hi"))
    filled = F.map_from_entries(F.transform("_have", lambda s: F.struct(s, F.lit(1.0))))
    return (
        spans.withColumn("_map", filled)
        .select(key, "_lo", "_map", F.explode(F.sequence("_lo", "_hi")).alias("_s"))
        .select(key, (F.col("_s") - F.col("_lo")).alias(name),
                F.coalesce(F.try_element_at("_map", F.col("_s")), F.lit(0.0)).alias("x"))
    )


def series_arrays(df: DataFrame, key: str, t: str = "t", x: str = "x", name: str = "xs") -> DataFrame:
    """One row per key with the values in time order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).cast("double").alias("x"))))
    return df.groupBy(key).agg(F.transform(packed, lambda e: e["x"]).alias(name))


def centred_means(stack: np.ndarray, w: int) -> np.ndarray:
    """Moving average of every row over ``w`` points, zero outside the row."""
    n = stack.shape[1]
    w = min(w, n)
    padded = np.pad(stack, ((0, 0), (w // 2, (w - 1) // 2)))
    return np.lib.stride_tricks.sliding_window_view(padded, w, axis=1).sum(axis=2) / w


def scaled_powers(stack: np.ndarray, w: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rescaled first half of the padded power spectrum per row, and which rows are flat."""
    n = stack.shape[1]
    nfft = 1 << (n - 1).bit_length() if n else 0
    if nfft < 2:
        return np.zeros((len(stack), 0)), np.zeros(len(stack), dtype=bool)
    if w:
        stack = stack - centred_means(stack, w)
    power = np.abs(np.fft.fft(stack, n=nfft, axis=1)) ** 2
    low, high = power.min(axis=1, keepdims=True), power.max(axis=1, keepdims=True)
    # rounding noise of a flat spectrum is no signal
    flat = high[:, 0] - low[:, 0] <= 1e-12 * np.maximum(1.0, (stack**2).sum(axis=1) * n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (power[:, : nfft // 2] - low) / (high - low), flat


def pieces_of(batch: pd.Series) -> Iterator[pd.Series]:
    """A batch of arrays cut into runs of rows of about ``CELLS`` values, so that neither stacks nor results grow with its rows."""
    sizes = batch.map(lambda v: 1 if v is None else len(v) + 1).to_numpy(dtype="int64")
    part = np.cumsum(sizes) // CELLS
    for p in np.unique(part):
        yield batch[part == p]


def stacks_by_length(batch: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and values of the arrays of a batch, one stack per length; nulls are skipped."""
    lengths = batch.map(lambda v: -1 if v is None else len(v)).to_numpy()
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        yield rows, np.stack([batch.iloc[r] for r in rows]).astype(float)


def half_power(xs: Column, w: int | None = None) -> Column:
    """Array column of powers 0..1 for bins 0 .. nfft/2 - 1; null for a flat spectrum.

    With ``w`` the series first loses its moving average over min(w, n) points, as in
    :func:`~spendlens.operators.windows.detrend`.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def transform(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in (piece for whole_batch in batches for piece in pieces_of(whole_batch)):
            out: list = [None] * len(batch)
            for rows, stack in stacks_by_length(batch):
                for r, values, is_flat in zip(rows, *scaled_powers(stack, w)):
                    out[r] = None if is_flat else values
            yield pd.Series(out, dtype=object)

    return transform(xs)


def period_fit(xs: Column, w: int | None = None) -> Column:
    """Strongest bin without the constant term, and the slope of power on period.

    Two numbers per series come back from Python instead of its spectrum. A series without
    a spectrum has bin 0 and slope 0.
    """

    @F.pandas_udf("bin int, slope double")
    def fit(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in (piece for whole_batch in batches for piece in pieces_of(whole_batch)):
            bins, slopes = np.zeros(len(batch), dtype="int32"), np.zeros(len(batch))
            for rows, stack in stacks_by_length(batch):
                powers, flat = scaled_powers(stack, w)
                half = powers.shape[1]
                rows, y = rows[~flat], powers[~flat, 1:]
                if half < 2 or not len(rows):
                    continue
                bins[rows] = 1 + np.floor(y * 10.0**TIE_DIGITS + 0.5).argmax(axis=1)
                if half > 2:
                    period = (2 * half - 2) / np.arange(1, half)
                    off = period - period.mean()
                    slopes[rows] = y @ off / (off @ off)
            yield pd.DataFrame({"bin": bins, "slope": slopes})

    return fit(xs)


def power_spectrum(df: DataFrame, key: str, t: str = "t", x: str = "x", grid: str = "span",
                   w: int | None = None, flat: bool = False) -> DataFrame:
    """Rows (key, nfft, bin, freq, period, power); flat and one-point series have none, or with
    ``flat`` one row without a bin."""
    spectra = series_arrays(df, key, t, x).select(
        key, array_nfft(F.col("xs")).alias("nfft"), half_power(F.col("xs"), w).alias("ps")
    )
    unfold = F.posexplode_outer if flat else F.posexplode
    return spectra.select(key, "nfft", unfold("ps").alias("bin", "power")).select(
        key, "nfft", "bin", bin_frequency(F.col("bin"), F.col("nfft")).alias("freq"),
        bin_period(F.col("bin"), F.col("nfft"), grid).alias("period"), "power",
    )


def strongest_bin(ps: Column, first: int = 0) -> Column:
    """First bin of largest power in an array of powers, from bin ``first`` on; 0 if none."""
    scale = 10.0**TIE_DIGITS
    tail = F.slice(ps, first + 1, 1 << 30) if first else ps
    ranked = F.transform(tail, lambda p, i: F.struct(F.floor(p * scale + 0.5), -i))
    return F.coalesce(F.lit(first) - F.array_max(ranked)["col2"], F.lit(0)).cast("int")


def array_nfft(xs: Column) -> Column:
    return next_pow2(F.greatest(F.size(xs), F.lit(1)))


def dominant_period(df: DataFrame, key: str, t: str = "t", x: str = "x", variant: str = "ceil",
                    w: int | None = None) -> DataFrame:
    """Rows (key, n, nfft, bin, period). ``nodc`` leaves the constant term out of the search."""
    arrays = series_arrays(df, key, t, x)
    found = arrays.select(
        key, F.size("xs").alias("n"), array_nfft(F.col("xs")).alias("nfft"),
        half_power(F.col("xs"), w).alias("_ps"),
    )
    best = found.withColumn("bin", strongest_bin(F.col("_ps"), 1 if variant == "nodc" else 0))
    return best.select(
        key, "n", "nfft", "bin", dominant(F.col("bin"), F.col("nfft"), variant).alias("period")
    )


def ols(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of y on x, per key."""
    return df.groupBy(key).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def seasonal_slope(spectrum: DataFrame, key: str, threshold: float = 0.001, on: str = "period") -> DataFrame:
    """Seasonal test: the slope of power on period (or frequency), constant term left out.

    A slope beyond the threshold in size makes the key seasonal, with the period of its
    strongest bin; otherwise the period is 0.
    """
    lit = spectrum.where(F.col("bin") > 0)
    best = F.max_by(
        F.struct("bin", "period"),
        F.struct(F.round("power", TIE_DIGITS), -F.col("bin")),
    )
    tested = lit.groupBy(key).agg(
        F.coalesce(F.regr_slope("power", on), F.lit(0.0)).alias("slope"), best.alias("_best")
    )
    seasonal = F.abs("slope") > threshold
    return tested.select(
        key, "slope", seasonal.cast("int").alias("seasonal"),
        F.when(seasonal, F.col("_best.period")).otherwise(F.lit(0.0)).alias("period"),
    )


def seasonal_slope_of_arrays(arrays: DataFrame, key: str, xs: str = "xs", w: int = 4,
                             threshold: float = 0.001) -> DataFrame:
    """:func:`seasonal_slope` for one row per key with the raw series as an array.

    Keys that have no spectrum (null, too short or flat) come out as not seasonal.
    """
    fitted = arrays.select(key, array_nfft(F.col(xs)).alias("nfft"), period_fit(F.col(xs), w).alias("_fit"))
    seasonal = F.abs("_fit.slope") > threshold
    period = F.when(seasonal, bin_period(F.col("_fit.bin"), F.col("nfft")))
    return fitted.select(
        key, seasonal.cast("int").alias("seasonal"), F.coalesce(period, F.lit(0.0)).alias("period"),
        F.col("_fit.slope").alias("slope"),
    )


def ks_uniform(spectrum: DataFrame, key: str, alpha: float = 0.05, terms: int = 100) -> DataFrame:
    """Kolmogorov-Smirnov distance of the powers from the uniform law, its asymptotic
    p-value, and the flag: different from uniform, and strongest outside the constant term.
    """
    w = along(key, "power")
    n = F.count("*").over(whole(key))
    i = F.row_number().over(w)
    ranked = spectrum.withColumns({
        "_n": n, "_d": F.greatest(i / n - F.col("power"), F.col("power") - (i - 1) / n),
    })
    best = F.max_by("bin", F.struct(F.round("power", TIE_DIGITS), -F.col("bin")))
    stats = ranked.groupBy(key, "nfft").agg(
        F.max("_n").alias("n"), F.max("_d").alias("distance"), best.alias("bin")
    )
    z = F.col("distance") * F.sqrt("n")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z * z),
    )
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(z < 0.2, F.lit(1.0)).otherwise(series)))
    return stats.withColumn("p_value", p).withColumn(
        "seasonal", ((F.col("p_value") < alpha) & (F.col("bin") != 0)).cast("int")
    )


def spectral_peaks(spectrum: DataFrame, key: str, c: float = 2.0) -> DataFrame:
    """Number of bins with power at or above mean + c * population deviation."""
    limit = F.avg("power").over(whole(key)) + c * F.stddev_pop("power").over(whole(key))
    return spectrum.withColumn("_limit", limit).groupBy(key).agg(
        F.count_if(F.abs("power") >= F.col("_limit")).alias("peaks")
    )


def spectral_cv(spectrum: DataFrame, key: str) -> DataFrame:
    """Population deviation over mean of the powers."""
    return spectrum.groupBy(key).agg(
        (F.stddev_pop("power") / F.nullif(F.avg("power"), F.lit(0.0))).alias("cv")
    )


def detrended_spectrum(df: DataFrame, key: str, t: str = "t", x: str = "x", w: int = 4, flat: bool = False) -> DataFrame:
    """Spectrum of the series less its moving average."""
    return power_spectrum(df, key, t, x, w=w, flat=flat)


def _lag_sums(at: pd.Series, c: pd.Series, i: pd.Series, j: pd.Series, block: int, cells: int) -> pd.DataFrame:
    """Per pair of blocks: first lag, and the sums of products at that lag and those after it.

    Pairs of one transform length are stacked, at most ``cells`` values at a time.
    """
    heads, tails, first, size = [], [], [], []
    for ts, cs, left, right in zip(at, c, i, j):
        ts, cs = np.asarray(ts, dtype="int64"), np.asarray(cs, dtype="float64")
        pair = []
        for b in (left, right):
            mine = ts // block == b
            spread = np.zeros(int(ts[mine].max()) - b * block + 1 if mine.any() else 1)
            spread[ts[mine] - b * block] = cs[mine]
            pair.append(spread)
        heads.append(pair[0])
        tails.append(pair[1])
        back = 0 if left == right else len(pair[0]) - 1
        first.append(int((right - left) * block - back))
        size.append(back + len(pair[1]))
    width = [1 << (len(a) + len(b) - 2).bit_length() for a, b in zip(heads, tails)]
    sums: list = [None] * len(heads)
    for length in sorted(set(width)):
        rows = [r for r, w in enumerate(width) if w == length]
        step = max(1, cells // length)
        for lo in range(0, len(rows), step):
            part = rows[lo:lo + step]
            a, b = np.zeros((len(part), length)), np.zeros((len(part), length))
            for slot, r in enumerate(part):
                a[slot, :len(heads[r])], b[slot, :len(tails[r])] = heads[r], tails[r]
            met = np.fft.irfft(np.conj(np.fft.rfft(a)) * np.fft.rfft(b), length)
            for slot, r in enumerate(part):
                back = size[r] - len(tails[r])
                sums[r] = np.concatenate([met[slot, length - back:], met[slot, :len(tails[r])]])
    return pd.DataFrame({"first": first, "sums": sums})


def acf(df: DataFrame, key: str, t: str = "t", x: str = "x", nlags: int | None = None,
        z: float = 1.959963984540054, block: int = 65_536) -> DataFrame:
    """Autocorrelation with Bartlett's standard error and a flag, at lags 0 .. n - 1, or 0 .. ``nlags``.

    ``t`` must count the rows of a key from 0. A key is cut into blocks of time, and every
    pair of blocks no further apart than the largest lag is correlated by a Fourier
    transform in an Arrow batch; sums of equal lags are then added. A key of any length is
    spread over tasks, and an ordinary key is a single block. Rows without a key belong to
    no series and are left out.
    """
    stats = aggregate_apart(
        df.where(F.col(key).isNotNull()), [key], F.avg(x).alias("_m"), F.count("*").alias("n"), F.max(t).alias("_last")
    )
    own, last = F.floor(F.col("_t") / block), F.floor(F.col("_last") / block)
    lo, hi = F.lit(0).cast("long"), last
    if nlags is not None:
        reach = -(-nlags // block)
        lo, hi = F.greatest(lo, own - reach), F.least(hi, own + reach)
    centred = df.join(stats, key).select(
        key, "n", "_last", F.col(t).cast("long").alias("_t"), (F.col(x) - F.col("_m")).alias("_c")
    )
    placed = centred.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(lo, hi)))
    pairs = placed.groupBy(
        key, "n", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")
    ).agg(F.collect_list(F.struct("_t", F.coalesce("_c", F.lit(0.0)).alias("_c"))).alias("_rows"))

    @F.pandas_udf("first long, sums array<double>")
    def lag_sums(at: pd.Series, c: pd.Series, i: pd.Series, j: pd.Series) -> pd.DataFrame:
        return _lag_sums(at, c, i, j, block, CELLS)

    met = pairs.select(key, "n", lag_sums(F.col("_rows._t"), F.col("_rows._c"), "_i", "_j").alias("_s"))
    lags = met.select(key, "n", F.col("_s.first").alias("_first"), F.posexplode("_s.sums").alias("_at", "_num")).select(
        key, "n", (F.col("_first") + F.col("_at")).alias("lag"), "_num"
    )
    top = F.col("n") - 1 if nlags is None else F.least(F.col("n") - 1, F.lit(nlags))
    sums = lags.where(F.col("lag").between(0, top)).groupBy(
        key, F.floor(F.col("lag") / block).alias("_part"), "lag", "n"
    ).agg(F.sum("_num").alias("_num"))
    # the error of a lag needs the squares of all lags before it: totals of whole parts, then
    # the running sum inside a part
    square = F.when(F.col("lag") > 0, F.col("_num") * F.col("_num")).otherwise(0.0)
    parts = sums.groupBy(F.col(key).alias("_of"), F.col("_part").alias("_piece")).agg(
        F.sum(square).alias("_squares"), F.max(F.when(F.col("lag") == 0, F.col("_num"))).alias("_zero")
    )
    ahead = along("_of", "_piece")
    heads = parts.select(
        "_of", "_piece", F.max("_zero").over(ahead).alias("_den"),
        F.coalesce(F.sum("_squares").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"),
    )
    inside = F.sum(square).over(along([key, "_part"], "lag").rowsBetween(Window.unboundedPreceding, -1))
    out = sums.withColumn("_inside", F.coalesce(inside, F.lit(0.0))).join(
        heads, (F.col(key) == F.col("_of")) & (F.col("_part") == F.col("_piece"))
    )
    varies = F.col("_den") > 0
    squares = F.when(varies, (F.col("_before") + F.col("_inside")) / F.col("_den") / F.col("_den")).otherwise(0.0)
    se = F.when(F.col("lag") == 0, 0.0).otherwise(F.sqrt((1 + 2 * squares) / F.col("n")))
    out = out.select(key, "n", "lag", F.when(varies, F.col("_num") / F.col("_den")).alias("r"), se.alias("se"))
    flag = ((F.col("lag") > 0) & (F.abs("r") > z * F.col("se"))).cast("int")
    return out.withColumn("significant", F.coalesce(flag, F.lit(0)))


def acf_flag(acf_rows: DataFrame, key: str, mode: str = "band") -> DataFrame:
    """Significant lags per key and the 0/1 flag.

    ``legacy`` follows the published comparison, which any series of two or more values
    that is not constant passes.
    """
    out = acf_rows.groupBy(key).agg(
        F.sum("significant").alias("lags"), F.max("n").alias("n"), F.max(F.col("r").isNotNull()).alias("_varies")
    )
    if mode == "legacy":
        flag = (F.col("n") >= 2) & F.col("_varies")
    else:
        flag = F.col("lags") > 0
    return out.select(key, "n", "lags", flag.cast("int").alias("flag"))
