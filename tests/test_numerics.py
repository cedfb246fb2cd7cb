"""Numeric operators against plain numpy written here."""

import datetime as dt

import numpy as np
import pytest

from spendlens.operators import anomaly, grouped, spectral, windows
from spendlens.plans import detect_cycle_seasonality, zero_budget_profile
from tests.test_golden import series

RNG = np.random.default_rng(5)
SERIES = [RNG.normal(size=n).cumsum() + 10 for n in (2, 3, 5, 8, 21, 40, 63)]


def by_key(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["key"], []).append(tuple(r[c] for c in cols))
    return {k: sorted(v) for k, v in out.items()}


def plain_average(x, w):
    w = min(w, len(x))
    padded = np.concatenate([np.zeros(w // 2), x, np.zeros((w - 1) // 2)])
    return np.array([padded[i:i + w].sum() / w for i in range(len(x))])


@pytest.mark.parametrize("w", [1, 2, 3, 4, 5, 12])
def test_detrend_in_rows_and_in_batches(spark, w):
    df = series(spark, *SERIES)
    got = by_key(windows.detrend(df, "key", "t", "x", w), "t", "detrended")
    for k, x in enumerate(SERIES):
        want = x - plain_average(x, w)
        assert np.allclose([v for _, v in got[k]], want)
        assert np.allclose(x - spectral.centred_means(x[None, :], w)[0], want)


def test_spectrum(spark):
    got = by_key(spectral.power_spectrum(series(spark, *SERIES), "key", w=4), "bin", "power")
    for k, x in enumerate(SERIES):
        d = x - plain_average(x, 4)
        nfft = 2 ** int(np.ceil(np.log2(len(x))))
        bins = np.arange(nfft)
        p = np.abs(np.exp(-2j * np.pi * np.outer(bins, np.arange(len(x))) / nfft) @ d) ** 2
        want = (p - p.min()) / (p.max() - p.min())
        assert np.allclose([v for _, v in got[k]], want[: nfft // 2])
        assert np.isclose(p.sum(), nfft * (d**2).sum())  # energy is kept


def plain_trend(x, p):
    p = len(x) - 1 if len(x) <= p else p
    weights = np.ones(p) if p % 2 else np.r_[0.5, np.ones(p - 1), 0.5]
    h, out = len(weights) // 2, np.full(len(x), np.nan)
    for i in range(h, len(x) - h):
        out[i] = (weights * x[i - h:i + h + 1]).sum() / p
    return out, p


@pytest.mark.parametrize("period", [2, 3, 4, 7, 19, 1000])
def test_decomposition(spark, period):
    from pyspark.sql import functions as F
    df = series(spark, *SERIES).withColumn("period", F.lit(float(period)))
    got = by_key(anomaly.decompose(df, "key"), "t", "trend", "seasonal", "resid")
    for k, x in enumerate(SERIES):
        trend, p = plain_trend(x, period)
        assert np.allclose([np.nan if v[1] is None else v[1] for v in got[k]], trend, equal_nan=True)
        off = x - trend
        means = np.array([np.nanmean(off[i::p]) if np.isfinite(off[i::p]).any() else np.nan for i in range(p)])
        if np.isfinite(means).all():
            want = (means - means.mean())[np.arange(len(x)) % p]
            assert np.allclose([v[2] for v in got[k]], want)


@pytest.mark.parametrize("nlags,block", [(6, 7), (6, 4096), (20, 7), (7, 7), (8, 7), (None, 7), (None, 4096)])
def test_autocorrelation(spark, nlags, block):
    df = series(spark, *SERIES)
    got = by_key(spectral.acf(df, "key", nlags=nlags, block=block), "lag", "r", "se", "significant")
    for k, x in enumerate(SERIES):
        c = x - x.mean()
        top = len(x) if nlags is None else min(nlags + 1, len(x))
        want = [(c[: len(c) - j] * c[j:]).sum() / (c * c).sum() for j in range(top)]
        assert [v[0] for v in got[k]] == list(range(top))
        assert np.allclose([v[1] for v in got[k]], want)
        se = [0.0] + [np.sqrt((1 + 2 * sum(r * r for r in want[1:j])) / len(x)) for j in range(1, len(want))]
        assert np.allclose([v[2] for v in got[k]], se)


def test_a_period_beyond_the_usual_lags_is_found(spark):
    from spendlens.plans import zero_budget_profile
    rows = [(1, i, 0.0 if i % 30 == 0 else 50.0) for i in range(300)] + [(None, 0, 0.0), (None, 1, 5.0)]
    df = spark.createDataFrame(rows, "key int, i int, budget double")
    got = {r["key"]: r for r in zero_budget_profile(df, "key", "budget", ["i"]).collect()}
    assert list(got) == [1] and got[1]["n"] == 300 and got[1]["lags"] > 0 and got[1]["flag"] == 1


def test_autocorrelation_of_a_constant(spark):
    rows = spectral.acf(series(spark, [3.0] * 6), "key", nlags=3)
    assert all(r["r"] is None and r["significant"] == 0 for r in rows.collect())
    assert spectral.acf_flag(rows, "key", "legacy").first()["flag"] == 0


def test_partial_autocorrelation(spark):
    got = by_key(grouped.pacf(spectral.acf(series(spark, *SERIES[4:]), "key", nlags=5), "key"), "lag", "pacf")
    for k, x in enumerate(SERIES[4:]):
        c = x - x.mean()
        r = np.array([(c[: len(c) - j] * c[j:]).sum() / (c * c).sum() for j in range(6)])
        for lag in range(1, 6):
            matrix = r[np.abs(np.subtract.outer(np.arange(lag), np.arange(lag)))]
            assert got[k][lag][1] == pytest.approx(np.linalg.solve(matrix, r[1:lag + 1])[-1])


def test_unit_root(spark):
    n = 200
    noise = RNG.normal(size=n)
    df = series(spark, noise.cumsum(), noise, [1.0] * 30)
    rows = {r["key"]: r for r in grouped.adf(df, "key", lags=2).collect()}
    assert rows[0]["stationary"] == 0 and rows[1]["stationary"] == 1
    assert rows[2]["statistic"] is None
    x = noise
    dx = np.diff(x)
    design = np.column_stack([x[2:-1], dx[1:-1], dx[:-2], np.ones(n - 3)])
    coef, res, *_ = np.linalg.lstsq(design, dx[2:], rcond=None)
    se = np.sqrt(res[0] / (n - 3 - 4) * np.linalg.inv(design.T @ design)[0, 0])
    assert rows[1]["statistic"] == pytest.approx(coef[0] / se)
    assert rows[1]["crit_5"] == pytest.approx(-2.8756, abs=2e-3)


def plain_lowess(y, frac, passes):
    n, near = len(y), max(2, int(frac * len(y) + 1e-10))
    t, robust, fit = np.arange(n, dtype=float), np.ones(len(y)), y.copy()
    for _ in range(passes + 1):
        for i in range(n):
            order = np.lexsort((t, np.abs(t - i)))[:near]
            h = np.abs(t[order] - i).max()
            w = np.where(np.abs(t[order] - i) < 0.999 * h, (1 - (np.abs(t[order] - i) / h) ** 3) ** 3, 0) * robust[order]
            fit[i] = np.polyval(np.polyfit(t[order], y[order], 1, w=np.sqrt(w)), i)
        off = np.abs(y - fit)
        u = off / (6 * np.median(off))
        robust = np.where(u < 0.999, (1 - u**2) ** 2, 0)
    return fit


def test_local_regression():
    y = np.sin(np.arange(40) / 6) + RNG.normal(size=40) * 0.1
    y[17] += 5
    assert np.allclose(grouped.lowess_fit(y, 0.75, 3), plain_lowess(y, 0.75, 3), atol=1e-6)
    line = 3.0 + 2.0 * np.arange(15)
    assert np.allclose(grouped.lowess_fit(line, 0.75, 3), line)


def test_forecast_of_a_known_recursion(spark):
    # x_t = x_{t-4} + 2: one seasonal difference leaves a constant
    x = [1.0, 5.0, 2.0, 9.0]
    for t in range(4, 24):
        x.append(x[t - 4] + 2)
    out = grouped.seasonal_forecast(series(spark, x), "key", p=1, d=0, seasonal_p=0, seasonal_d=1, s=4, h=4)
    got = by_key(out.where("kind = 'forecast'"), "t", "value")[0]
    assert np.allclose([v for _, v in got], [x[20 + i] + 2 for i in range(4)])
    joined = by_key(out.where("kind = 'joined'"), "t", "value")[0]
    assert joined[0][1] == pytest.approx(x[-1])


def test_ks_distance_and_p_value(spark):
    from pyspark.sql import functions as F
    spec = spectral.power_spectrum(series(spark, *SERIES[3:]), "key", w=4)
    powers = by_key(spec, "power")
    for r in spectral.ks_uniform(spec, "key").collect():
        y = np.sort([v[0] for v in powers[r["key"]]])
        n = len(y)
        d = max((np.arange(1, n + 1) / n - y).max(), (y - np.arange(n) / n).max())
        k = np.arange(1, 101)
        assert r["distance"] == pytest.approx(d)
        assert r["p_value"] == pytest.approx(
            min(1.0, 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * d * d * n)).sum()), abs=1e-9)


def plain_cycle_test(cycles, w=4, threshold=0.001):
    """Seasonal flag and period of one advertiser's cycles, day by day."""
    cycles = sorted(cycles)
    if len(cycles) < w:
        return 0, 0.0
    start = cycles[0][0]
    x = np.ones(cycles[-1][1] - start)
    for (_, e), (s, _) in zip(cycles, cycles[1:]):
        x[max(0, e - start):max(0, s - start)] = 0 if s > e else x[max(0, e - start):max(0, s - start)]
    x = x - plain_average(x, w)
    nfft = 1 << (len(x) - 1).bit_length()
    p = np.abs(np.fft.fft(x, nfft)) ** 2
    y = ((p - p.min()) / (p.max() - p.min()))[1:nfft // 2]
    period = (nfft - 2) / np.arange(1, nfft // 2)
    slope = np.polyfit(period, y, 1)[0]
    return (1, period[np.argmax(np.round(y, 9))]) if abs(slope) > threshold else (0, 0.0)


def test_seasonality_of_cycles(spark):
    rows, want = [], {}
    for key in range(25):
        n, day, mine = int(RNG.integers(1, 14)), int(RNG.integers(0, 50)), []
        for _ in range(n):
            length = int(RNG.integers(5, 40))
            mine.append((day, day + length))
            day += length + int(RNG.integers(-4, 40))
        want[key] = plain_cycle_test(mine)
        rows += [(len(rows) + i, key, dt.date(2015, 1, 1) + dt.timedelta(a), dt.date(2015, 1, 1) + dt.timedelta(b))
                 for i, (a, b) in enumerate(mine)]
    df = spark.createDataFrame(rows, "cycle_id long, key long, started date, ended date")
    got = {r["key"]: (r["seasonal"], r["period"]) for r in detect_cycle_seasonality(df, "key").collect()}
    assert set(got) == set(want)
    for key in want:
        assert got[key][0] == want[key][0]
        assert got[key][1] == pytest.approx(want[key][1])


def test_zero_budget_profile(spark):
    rows = [(1, i, 0.0) for i in range(5)]                       # zero in total: dropped
    rows += [(2, i, 0.0 if i % 4 == 0 else 100.0) for i in range(60)]  # every fourth cycle
    rows += [(3, i, 50.0) for i in range(9)]                     # never zero: not tested
    df = spark.createDataFrame(rows, "key long, cycle long, budget double")
    got = {r["key"]: r for r in zero_budget_profile(df, "key", "budget", ["cycle"]).collect()}
    assert set(got) == {2}
    assert got[2]["n"] == 60 and got[2]["flag"] == 1


def test_short_series_get_no_forecast(spark):
    out = grouped.seasonal_forecast(series(spark, np.arange(10.0)), "key", s=12, h=3).collect()
    assert len(out) == 6 and all(r["value"] is None and r["status"] == "short" for r in out)


def test_unit_root_p_value_and_lags(spark):
    # published 5 percent point of the limit law, and continuity where the polynomial changes
    assert grouped.unit_root_p(-2.86154) == pytest.approx(0.05, abs=5e-4)
    assert grouped.unit_root_p(-1.61) == pytest.approx(grouped.unit_root_p(-1.609999), abs=2e-3)
    assert grouped.unit_root_p(-30.0) == 0.0 and grouped.unit_root_p(5.0) == 1.0
    rng = np.random.default_rng(4)
    noise = rng.normal(size=120)
    echo = np.zeros(120)
    for i in range(120):
        echo[i] = noise[i] + (0.8 * echo[i - 5] if i >= 5 else 0.0)
    df = series(spark, noise, echo, noise[:4])
    rows = {r["key"]: r for r in grouped.adf(df, "key").collect()}
    # the least criterion, by hand on one common set of rows
    for k, x in enumerate((noise, echo)):
        dx, top = np.diff(x), len(x) // 2 - 3
        score = []
        for lags in range(top + 1):
            cols = [x[top:-1]] + [dx[top - j:len(dx) - j] for j in range(1, lags + 1)] + [np.ones(len(dx) - top)]
            rss = np.linalg.lstsq(np.column_stack(cols), dx[top:], rcond=None)[1][0]
            score.append((len(dx) - top) * np.log(rss / (len(dx) - top)) + 2 * (lags + 2))
        assert rows[k]["lags"] == int(np.argmin(score))
    assert rows[1]["lags"] >= 4
    assert rows[2]["statistic"] is None and rows[2]["p_value"] is None
    fixed = {r["key"]: r for r in grouped.adf(df, "key", lags=1).collect()}
    assert fixed[0]["lags"] == 1 and fixed[0]["stationary"] == 1 and fixed[0]["p_value"] < 0.01
