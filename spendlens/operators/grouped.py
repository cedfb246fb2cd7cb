"""Operators with no built-in form: local regression, partial autocorrelation, unit-root
test and seasonal forecast.

Spark gathers each bounded series into an array on its key. The kernels below work on
stacks: all series of one length that lie in an Arrow batch, as one matrix, cut so that no
stack holds more than ``CELLS`` values. There is no Python call per key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anomaly import decomposition_trend, filled_trend
from .spectral import CELLS, series_arrays


def stacked(kernel: Callable[..., dict], schema: str, *arrays: Column) -> Column:
    """Struct column of what ``kernel`` makes of array columns.

    The kernel gets one matrix per array column, a row per series, and returns named values with
    a row (a number or an array) per series. Series of one length share a call; a null array gives nulls.
    """

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch if isinstance(batch, tuple) else (batch,)
            lengths = batch[0].map(lambda v: -1 if v is None else len(v)).to_numpy()
            out: dict[str, list] = {name.split()[0]: [None] * len(lengths) for name in schema.split(", ")}
            for n in np.unique(lengths[lengths >= 0]):
                rows = np.flatnonzero(lengths == n)
                for at in range(0, len(rows), step := max(1, CELLS // max(int(n), 1))):
                    some = rows[at:at + step]
                    stacks = [np.stack([column.iloc[r] for r in some]).astype(float) for column in batch]
                    for name, values in kernel(*stacks).items():
                        for r, value in zip(some, values):
                            out[name][r] = value
            yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in out.items()})

    return run(*arrays)


def sliced_rows(stack: np.ndarray, cells: int) -> Iterator[slice]:
    """Slices of the rows of a stack of which each takes ``cells`` values, ``CELLS`` together at most."""
    step = max(1, CELLS // max(1, cells))
    return (slice(at, at + step) for at in range(0, len(stack), step))


# --- local regression -------------------------------------------------------------------------


def tricube(n: int, near: int, lo: int, hi: int) -> np.ndarray:
    """Weights of all points in the local lines at the points ``lo .. hi-1``: zero beyond the ``near`` nearest."""
    here, there = np.arange(lo, hi)[:, None], np.arange(n)[None, :]
    left = np.clip(here - (near - 1) // 2, 0, n - near)
    reach = np.maximum(np.maximum(here - left, left + near - 1 - here), 1)
    share = np.abs(there - here) / reach
    weights = np.where(share <= 0.001, 1.0, np.where(share < 0.999, (1 - share**3) ** 3, 0.0))
    return np.where((there >= left) & (there < left + near), weights, 0.0)


def lowess_stack(stack: np.ndarray, frac: float, passes: int) -> np.ndarray:
    """Locally weighted lines at every point of evenly spaced series of one length.

    Tricube weights over the nearest ``frac`` of the points depend on the length alone, so the weighted sums of
    all series are matrix products with them; ``passes`` rounds of bisquare weights against outliers follow.
    """
    m, n = stack.shape
    if not n:
        return stack.astype(float)
    near = min(n, max(2, int(frac * n + 1e-10)))
    level = stack.mean(axis=1, keepdims=True)
    y, fit, robust = stack - level, np.zeros((m, n)), np.ones((m, n))
    still = np.arange(m)  # series that outliers may still move
    for _ in range(passes + 1):
        v, r = y[still], robust[still]
        for lo in range(0, n, step := max(1, CELLS // n)):
            hi = min(n, lo + step)
            weights = tricube(n, near, lo, hi).T
            off = np.arange(n)[:, None] - np.arange(lo, hi)[None, :]
            total = r @ weights
            ok = total > 1e-12
            safe = np.where(ok, total, 1.0)
            tm, ym = (r @ (weights * off)) / safe, ((r * v) @ weights) / safe
            spread = (r @ (weights * off**2)) / safe - tm**2
            cov = ((r * v) @ (weights * off)) / safe - tm * ym
            slope = np.where(spread > 1e-12, cov / np.where(spread > 1e-12, spread, 1.0), 0.0)
            fit[still, lo:hi] = np.where(ok, ym - slope * tm, v[:, lo:hi])
        resid = np.abs(v - fit[still])
        scale = 6.0 * np.median(resid, axis=1)
        moving = scale > 1e-12 * np.maximum(1.0, np.abs(stack[still]).max(axis=1))
        still, share = still[moving], resid[moving] / scale[moving, None]
        robust[still] = np.where(share <= 0.001, 1.0, np.where(share < 0.999, (1 - share**2) ** 2, 0.0))
        if not len(still):
            break
    return fit + level


def lowess_fit(y: np.ndarray, frac: float, passes: int) -> np.ndarray:
    """One series of :func:`lowess_stack`."""
    return lowess_stack(np.asarray(y, float)[None, :], frac, passes)[0]


def lowess_deviation(df: DataFrame, key: str, period: str = "period", t: str = "t", x: str = "x",
                     frac: float = 0.75, passes: int = 3, threshold: float = 0.8,
                     against: str = "trend", keep: tuple = ()) -> DataFrame:
    """Rows (key, t, trend, smooth, score, flag) from a robust local regression of the trend.

    ``trend``: distance of the smooth from the trend over its maximum, flagged above the
    threshold. ``signal``: distance from the series, flagged above threshold times its
    population deviation. Columns named in ``keep`` are carried along.
    """
    if against not in ("trend", "signal"):
        raise ValueError(f"against must be 'trend' or 'signal', not {against!r}")
    parts = decomposition_trend(df, [key], t, x, period).withColumn("trend", filled_trend([key]))
    rows = parts.select(key, F.struct(
        F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("x"),
        F.coalesce(F.col("trend"), F.col(x)).cast("double").alias("trend"), *keep).alias("_point"))
    arrays = rows.groupBy(key).agg(F.array_sort(F.collect_list("_point")).alias("_points"))

    def smooth(trend: np.ndarray, values: np.ndarray) -> dict:
        fit = lowess_stack(trend, frac, passes)
        off = np.abs(fit - (trend if against == "trend" else values))
        limit = off.max(axis=1, keepdims=True) if against == "trend" else off.std(axis=1, keepdims=True)
        return {"smooth": fit, "score": np.where(limit > 0, off / np.where(limit > 0, limit, 1.0), 0.0)}

    fitted = arrays.withColumn("_fit", stacked(smooth, "smooth array<double>, score array<double>", F.col("_points.trend"), F.col("_points.x")))
    points = fitted.select(key, F.posexplode("_points").alias("_i", "_p"), "_fit")
    return points.select(
        key, "_p.t", "_p.trend", F.col("_fit.smooth")[F.col("_i")].alias("smooth"), F.col("_fit.score")[F.col("_i")].alias("score"),
        *[F.col(f"_p.{c}").alias(c) for c in keep],
    ).withColumn("flag", (F.col("score") > threshold).cast("int")).select(key, "t", "trend", "smooth", "score", "flag", *keep)


# --- partial autocorrelation ------------------------------------------------------------------


def levinson_stack(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of a stack of autocorrelations r[0..m], r[0] = 1; missing where the
    recursion has nothing left to explain, or where an autocorrelation is missing."""
    rows, m = r.shape[0], r.shape[1] - 1
    out = np.full(r.shape, np.nan)
    out[:, :1] = 1.0
    phi, err = np.zeros((rows, max(m, 0))), np.ones(rows)
    for k in range(1, m + 1):
        with np.errstate(invalid="ignore", divide="ignore"):
            last = np.where(err > 1e-14, (r[:, k] - (phi[:, : k - 1] * r[:, k - 1:0:-1]).sum(axis=1)) / err, np.nan)
        phi[:, : k - 1] -= last[:, None] * phi[:, k - 2::-1] if k > 1 else 0.0
        phi[:, k - 1] = last
        err = err * (1 - last * last)
        out[:, k] = last
    out[~np.isfinite(r).all(axis=1)] = np.nan
    return out


def pacf(acf_rows: DataFrame, key: str) -> DataFrame:
    """Partial autocorrelations by the Durbin recursion on the rows of ``acf``, run for all keys of a stack at once."""
    known = acf_rows.select(key, F.col("lag").cast("long").alias("lag"), F.coalesce(F.col("r"), F.lit(float("nan"))).alias("r"))
    solved = series_arrays(known, key, "lag", "r").select(
        key, stacked(lambda r: {"pacf": levinson_stack(r)}, "pacf array<double>", F.col("xs")).alias("_s"))
    return solved.select(key, F.posexplode("_s.pacf").alias("lag", "pacf")).select(
        key, F.col("lag").cast("long").alias("lag"), F.when(~F.isnan("pacf"), F.col("pacf")).alias("pacf"))


# --- unit root --------------------------------------------------------------------------------

# fixed values: published 1, 5 and 10 percent points of the unit-root t statistic with a
# constant, as the coefficients of 1, 1/n, 1/n^2, 1/n^3
UNIT_ROOT_POINTS = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}


# fixed values: published response surface of the p-value of that statistic: lower and upper end, the
# point where the polynomial changes, and its coefficients below and above (constant term first)
UNIT_ROOT_RANGE = (-18.83, -1.61, 2.74)
UNIT_ROOT_LOW = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(stat: float) -> float:
    """p-value of the unit-root t statistic with a constant."""
    lowest, turn, highest = UNIT_ROOT_RANGE
    if not np.isfinite(stat):
        return float("nan")
    if stat < lowest or stat > highest:
        return float(stat > highest)
    at = sum(c * stat**i for i, c in enumerate(UNIT_ROOT_LOW if stat <= turn else UNIT_ROOT_HIGH))
    return 0.5 * math.erfc(-at / math.sqrt(2.0))


def lagged_changes(x: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a stack: changes from the ``skip``-th on, the levels before them, and their ``lags`` earlier changes."""
    dx = np.diff(x, axis=1)
    n = dx.shape[1] - skip
    earlier = [dx[:, skip - k: skip - k + n] for k in range(1, lags + 1)]
    return dx[:, skip:], x[:, skip:-1], np.stack(earlier, axis=2) if earlier else np.zeros((len(x), n, 0))


def _factored(design: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orthogonal columns, the diagonal of the triangle, and whether each column adds a direction to those before it."""
    q, r = np.linalg.qr(design)
    diagonal = np.diagonal(r, axis1=1, axis2=2)
    size = np.sqrt((design**2).sum(axis=1)).max(axis=1, keepdims=True)
    return q, diagonal, np.abs(diagonal) > np.finfo(float).eps * max(design.shape[1:]) * size


def unit_root_lags(x: np.ndarray) -> np.ndarray:
    """Per series of a stack, the number of lags with the least criterion (Akaike) among 0 .. n/2 - 3, the most that leave
    enough observations, all compared on the same rows.

    The design of all lags is factored once. Its orthogonal columns take their share of the squares one after another,
    so the residual of every shorter number of lags is a running difference.
    """
    top = max(0, x.shape[1] // 2 - 3)
    n = x.shape[1] - 1 - top
    if n <= 3:
        return np.zeros(len(x), np.int64)
    best = np.zeros(len(x), np.int64)
    for part in sliced_rows(x, n * (top + 2)):
        y, level, earlier = lagged_changes(x[part], top, top)
        q, _, adds = _factored(np.concatenate([np.ones_like(level)[..., None], level[..., None], earlier], axis=2))
        taken = np.cumsum((q * y[..., None]).sum(axis=1) ** 2, axis=1)[:, 1:]
        left = (y**2).sum(axis=1, keepdims=True) - taken
        whole = np.logical_and.accumulate(adds, axis=1)[:, 1:]
        lags = np.arange(top + 1)
        fits = whole & (left > 0) & (n > lags + 3)
        score = np.where(fits, n * np.log(np.where(fits, left, 1.0) / n) + 2 * (lags + 2), np.inf)
        best[part] = score.argmin(axis=1)
    return best


def unit_root_fit(x: np.ndarray, lags: int) -> np.ndarray:
    """Per series of a stack, the t statistic of the level in a regression of the change on level, ``lags`` earlier
    changes and a constant; missing without enough observations or with dependent columns."""
    n = x.shape[1] - 1 - lags
    out = np.full(len(x), np.nan)
    if n <= lags + 3:
        return out
    for part in sliced_rows(x, n * (lags + 2)):
        y, level, earlier = lagged_changes(x[part], lags, lags)
        # the level comes last, so its coefficient needs no back substitution
        q, diagonal, adds = _factored(np.concatenate([np.ones_like(level)[..., None], earlier, level[..., None]], axis=2))
        along = (q * y[..., None]).sum(axis=1)
        left = (y**2).sum(axis=1) - (along**2).sum(axis=1)
        fits = adds.all(axis=1) & (left > 1e-14 * (y**2).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            out[part] = np.where(fits, np.sign(diagonal[:, -1]) * along[:, -1] / np.sqrt(left / (n - lags - 2)), np.nan)
    return out


def adf(df: DataFrame, key: str, t: str = "t", x: str = "x", lags: int | None = None) -> DataFrame:
    """Augmented unit-root test with a constant: number of lags, statistic, p-value, published
    critical values, and whether a unit root is rejected at 5 percent.

    Without ``lags`` each series takes the number with the least criterion.
    """

    def test(stack: np.ndarray) -> dict:
        used = unit_root_lags(stack) if lags is None else np.full(len(stack), lags)
        stat = np.full(len(stack), np.nan)
        for count in np.unique(used):
            stat[used == count] = unit_root_fit(stack[used == count], int(count))
        return {"n_obs": np.maximum(stack.shape[1] - 1 - used, 0), "lags": used, "statistic": stat, "p_value": [unit_root_p(s) for s in stat]}

    found = series_arrays(df, key, t, x).select(
        key, stacked(test, "n_obs long, lags int, statistic double, p_value double", F.col("xs")).alias("_s")).select(key, "_s.*")
    found = found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("statistic", "p_value")})
    size = F.greatest("n_obs", F.lit(1)).cast("double")
    crit = {name: sum(F.lit(c) / size**i for i, c in enumerate(cs)) for name, cs in UNIT_ROOT_POINTS.items()}
    return found.withColumns(crit).withColumn("stationary", F.coalesce(F.col("statistic") < F.col("crit_5"), F.lit(False)).cast("int"))


# --- seasonal forecast ------------------------------------------------------------------------


def product_lags(p: int, seasonal_p: int, s: int) -> list[int]:
    """Lags of a multiplicative seasonal polynomial."""
    return sorted({i + j * s for i in range(p + 1) for j in range(seasonal_p + 1)} - {0})


def least_squares(design: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Coefficients of a stack of regressions; the smallest ones where columns depend on each other."""
    out = np.zeros((len(design), design.shape[2]))
    for part in sliced_rows(design, design.shape[1] * design.shape[2]):
        inverse = np.linalg.pinv(design[part], rcond=np.finfo(float).eps * max(design.shape[1:]))
        out[part] = np.einsum("mij,mj->mi", inverse, target[part])
    return out


def lagged(z: np.ndarray, lags: list[int], start: int) -> np.ndarray:
    """(series, time from ``start`` on, lag): earlier values of a stack."""
    n = z.shape[1] - start
    return np.stack([z[:, start - k: start - k + n] for k in lags], axis=2) if lags else np.zeros((len(z), n, 0))


def _with_constant(columns: np.ndarray) -> np.ndarray:
    return np.concatenate([columns, np.ones((*columns.shape[:2], 1))], axis=2)


def forecast_stack(x: np.ndarray, p: int, d: int, q: int, seasonal_p: int, seasonal_d: int, seasonal_q: int, s: int,
                   h: int) -> tuple[np.ndarray, np.ndarray]:
    """In-sample one-step predictions (NaN where history is missing) and ``h`` forecasts of a stack, which
    are NaN if the history is too short for a fit.

    Moving-average terms need the disturbances, which nobody has seen. A long autoregression, as deep as all lags of the
    model reach together, gives residuals in their place; their lags then stand beside those of the series in one regression.
    """
    poly = np.array([1.0])
    for lag in [1] * d + [s] * seasonal_d:
        poly = np.convolve(poly, np.r_[1.0, np.zeros(lag - 1), -1.0])
    lost = len(poly) - 1
    m, n = x.shape
    ar, ma = product_lags(p, seasonal_p, s), product_lags(q, seasonal_q, s)
    long = max(ar + ma) if ma else 0
    deep = max(max(ar, default=0), long + max(ma, default=0))
    fitted, ahead = np.full((m, n), np.nan), np.full((m, h), np.nan)
    rows = n - lost - deep
    if rows <= len(ar) + len(ma) + 1 or (ma and n - lost - long <= long + 1):
        return fitted, ahead
    z = sum(c * x[:, lost - k: n - k] for k, c in enumerate(poly) if c)
    noise = np.zeros_like(z)
    if ma:
        design = _with_constant(lagged(z, list(range(1, long + 1)), long))
        noise[:, long:] = z[:, long:] - np.einsum("mij,mj->mi", design, least_squares(design, z[:, long:]))
    design = _with_constant(np.concatenate([lagged(z, ar, deep), lagged(noise, ma, deep)], axis=2))
    coef = least_squares(design, z[:, deep:])
    fitted[:, lost + deep:] = x[:, lost + deep:] - z[:, deep:] + np.einsum("mij,mj->mi", design, coef)
    xs, zs, es = (np.concatenate([v, np.zeros((m, h))], axis=1) for v in (x, z, noise))  # disturbances ahead are expected to be 0
    for i in range(h):
        here = z.shape[1] + i
        zs[:, here] = coef[:, -1] + (coef[:, : len(ar)] * zs[:, [here - k for k in ar]]).sum(axis=1) \
            + (coef[:, len(ar):-1] * es[:, [here - k for k in ma]]).sum(axis=1)
        xs[:, n + i] = zs[:, here] - sum(c * xs[:, n + i - k] for k, c in enumerate(poly) if k)
    return fitted, xs[:, n:]


def seasonal_forecast(df: DataFrame, key: str, t: str = "t", x: str = "x", p: int = 2, d: int = 1,
                      seasonal_p: int = 1, seasonal_d: int = 1, s: int = 12, h: int = 12, q: int = 0, seasonal_q: int = 0) -> DataFrame:
    """Seasonal autoregression, with moving-average terms if ``q`` or ``seasonal_q`` is given, on the
    differenced series by conditional least squares.

    Rows (key, t, kind, value, status): ``fitted`` in the sample, then ``h`` ``forecast`` rows, and
    ``joined``, the forecast shifted so that it continues the last prediction. A series too
    short for a fit has status ``short`` and null forecasts, any other ``ok``.
    """

    def run(stack: np.ndarray) -> dict:
        fitted, ahead = forecast_stack(stack, p, d, q, seasonal_p, seasonal_d, seasonal_q, s, h)
        return {"fitted": fitted, "ahead": ahead}

    points = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("x")))).alias("_p"))
    made = points.withColumn("_s", stacked(run, "fitted array<double>, ahead array<double>", F.col("_p.x"))).select(key, "_p", "_s.*")
    none = lambda v: F.when(~F.isnan(v), v)
    ready = made.select(
        key, "_p", F.transform("fitted", none).alias("fitted"), F.transform("ahead", none).alias("ahead"),
        (F.element_at("_p", F.lit(-1))["t"] + 1).alias("_next"),
        F.coalesce(none(F.element_at("fitted", F.lit(-1))), F.element_at("_p", F.lit(-1))["x"]).alias("_last"))
    status = F.when(F.exists("fitted", lambda v: v.isNotNull()), "ok").otherwise("short")
    row = lambda at, kind, v: F.struct(at.alias("t"), F.lit(kind).alias("kind"), v.alias("value"))
    inside = F.filter(F.zip_with("_p", "fitted", lambda e, v: row(e["t"], "fitted", v)), lambda e: e["value"].isNotNull())
    joined = F.transform("ahead", lambda v: v - F.get("ahead", F.lit(0)) + F.col("_last"))
    later = lambda kind: lambda v, i: row(F.col("_next") + i, kind, v)
    rows = F.concat(inside, F.transform("ahead", later("forecast")), F.transform(joined, later("joined")))
    return ready.select(key, status.alias("status"), F.inline(rows)).select(key, "t", "kind", "value", "status")
