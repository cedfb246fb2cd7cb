"""Stacked kernels, selection by rank, samples, change types and sketches."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.operators import clean, grouped, ranks, sketches, spectral, windows
from spendlens.operators.anomaly import collapse_in_place, collapse_runs, mark_extrema
from spendlens.plans import change_types, detect_anomalies
from spendlens.sources import row_range
from tests.test_numerics import plain_lowess, series


def test_a_stack_is_fitted_like_its_rows():
    rng = np.random.default_rng(2)
    stack = np.sin(np.arange(40) / 6) * 1e5 + rng.normal(size=(6, 40)) * 1e4
    stack[2, 17] += 1e6
    stack[3] = 7.0
    stack[4] = 3.0 * np.arange(40)
    got = grouped.lowess_stack(stack, 0.75, 3)
    for row in (0, 1, 2, 5):
        assert np.allclose(got[row], plain_lowess(stack[row], 0.75, 3), rtol=1e-8)
    assert np.allclose(got[3:5], stack[3:5])
    assert grouped.lowess_stack(np.array([[1.0], [2.0]]), 0.75, 3).tolist() == [[1.0], [2.0]]
    assert grouped.lowess_stack(np.array([[1.0, 5.0]]), 0.75, 3).tolist() == [[1.0, 5.0]]


def test_weights_are_cut_into_slices(monkeypatch):
    rng = np.random.default_rng(3)
    stack = rng.normal(size=(5, 60)).cumsum(axis=1)
    want = grouped.lowess_stack(stack, 0.5, 2)
    monkeypatch.setattr(grouped, "CELLS", 200)
    assert np.allclose(grouped.lowess_stack(stack, 0.5, 2), want)
    assert (grouped.unit_root_lags(stack) == grouped.unit_root_lags(stack[:, :])).all()


def test_partial_autocorrelation_of_a_stack():
    rng = np.random.default_rng(5)
    r = np.column_stack([np.ones(4), rng.uniform(-0.5, 0.5, (4, 6))])
    r[3, 2] = np.nan
    r[2, 1:] = 1.0  # nothing is left to explain after the first lag
    got = grouped.levinson_stack(r)
    for k in range(2):
        for lag in range(1, 7):
            matrix = r[k][np.abs(np.subtract.outer(np.arange(lag), np.arange(lag)))]
            assert got[k, lag] == pytest.approx(np.linalg.solve(matrix, r[k, 1:lag + 1])[-1])
    assert got[2, 1] == 1.0 and np.isnan(got[2, 2:]).all() and np.isnan(got[3]).all()


def test_lags_of_a_long_series_take_seconds():
    x = np.random.default_rng(6).normal(size=(1, 4000)).cumsum(axis=1)
    start = time.perf_counter()
    lags = grouped.unit_root_lags(x)
    assert 0 <= lags[0] <= 1997 and time.perf_counter() - start < 60


def plain_forecast(x, p, d, q, sp, sd, sq, s, h):
    """One series, one loop per step."""
    poly = np.array([1.0])
    for lag in [1] * d + [s] * sd:
        poly = np.convolve(poly, [1.0] + [0.0] * (lag - 1) + [-1.0])
    lost = len(poly) - 1
    z = np.array([sum(poly[k] * x[t - k] for k in range(lost + 1)) for t in range(lost, len(x))])
    lags = lambda a, b: sorted({i + j * s for i in range(a + 1) for j in range(b + 1)} - {0})
    ar, ma = lags(p, sp), lags(q, sq)
    deep = max(ar + ma)
    e = np.zeros(len(z))
    rows = [[z[t - k] for k in range(1, deep + 1)] + [1.0] for t in range(deep, len(z))]
    e[deep:] = z[deep:] - np.array(rows) @ np.linalg.lstsq(np.array(rows), z[deep:], rcond=None)[0]
    start = deep + max(ma)
    rows = np.array([[z[t - k] for k in ar] + [e[t - k] for k in ma] + [1.0] for t in range(start, len(z))])
    coef = np.linalg.lstsq(rows, z[start:], rcond=None)[0]
    fitted = {lost + t: x[lost + t] - z[t] + rows[t - start] @ coef for t in range(start, len(z))}
    zs, es, xs = list(z), list(e), list(x)
    for _ in range(h):
        zs.append(sum(c * zs[-k] for c, k in zip(coef, ar)) + sum(c * es[-k] for c, k in zip(coef[len(ar):], ma)) + coef[-1])
        es.append(0.0)
        xs.append(zs[-1] - sum(poly[k] * xs[-k] for k in range(1, lost + 1)))
    return fitted, xs[len(x):]


def test_forecast_with_moving_average_terms(spark):
    rng = np.random.default_rng(7)
    t = np.arange(90)
    data = [10 * np.sin(2 * np.pi * t / 7) + rng.normal(size=90).cumsum() for _ in range(3)] + [rng.normal(size=60).cumsum(), np.arange(20.0)]
    out = grouped.seasonal_forecast(series(spark, *data), "key", p=2, d=1, q=1, seasonal_p=1, seasonal_d=1, seasonal_q=1, s=7, h=12).collect()
    for k, x in enumerate(data[:4]):
        fitted, ahead = plain_forecast(x, 2, 1, 1, 1, 1, 1, 7, 12)
        mine = {(r["kind"], r["t"]): r["value"] for r in out if r["key"] == k}
        assert {i: v for (kind, i), v in mine.items() if kind == "fitted"} == pytest.approx(fitted, abs=1e-6)
        assert [mine["forecast", len(x) + i] for i in range(12)] == pytest.approx(ahead, abs=1e-5)
        assert mine["joined", len(x)] == pytest.approx(fitted[len(x) - 1])
    assert {r["status"] for r in out if r["key"] == 4} == {"short"}


def test_row_range_by_rank(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 300)
    monkeypatch.setattr(ranks, "SAMPLE", 100)
    v = F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 7919 % 97)  # a third of the rows tie
    df = spark.range(3_000).select("id", v.alias("v"), F.concat(F.lit("k"), F.col("id") % 13).alias("s")).repartition(2).cache()
    want = df.toPandas()
    for order, ranges in ((["v", "id"], ((0, 10), (999, 800), (2_990, 50))), (["s", "v", "id"], ((700, 900),)), (["id"], ((3_000, 5), (40, 0)))):
        ordered = want.sort_values(order, na_position="first")["id"].tolist()
        for lo, n in ranges:
            part = row_range(df, lo, n, order)
            assert sorted(r["id"] for r in part.collect()) == sorted(ordered[lo:lo + n]), (order, lo, n)
    plan = row_range(df, 700, 900, ["v", "id"])._jdf.queryExecution().toString()
    assert "Sort" not in plan and "ExistingRDD" not in plan


def test_row_sample_is_the_same_on_any_partitioning(spark):
    df = spark.range(50_000)
    few, more = ({r["id"] for r in clean.sample_rows(x, "id", share, seed=3).collect()} for x, share in ((df, 0.01), (df.repartition(9), 0.05)))
    assert few < more and 400 < len(few) < 600 and 2300 < len(more) < 2700
    assert clean.sample_rows(df, "id", 1.0).count() == 50_000 and clean.sample_rows(df, "id", 0.0).count() == 0


def test_change_types(spark):
    x = [0, 0, 5, 5, 9, 4, 0, 4, 0, 0, 0, 0, 7, None]
    rows = [(1, i, None if v is None else float(v)) for i, v in enumerate(x)] + [(2, 0, 0.0), (2, 1, 0.0), (None, 0, 3.0)]
    got = change_types(spark.createDataFrame(rows, "key int, t int, x double"), "key").orderBy("t").collect()
    assert [(r["t"], r["change_type"]) for r in got] == [
        (2, "New"), (3, "No change"), (4, "Change up"), (5, "Change down"), (6, "Idle down"), (7, "Idle up"), (8, "Idle down"),
        (9, "Churn"), (12, "Idle up"), (13, "Idle down")]
    assert {r["key"] for r in got} == {1}


def test_sketches_are_near_the_exact_counts(spark):
    a = spark.range(200_000).select((F.col("id") % 120_000).alias("k"), (F.col("id") % 3).alias("d"))
    b = spark.range(90_000, 250_000).select(F.col("id").alias("k"))
    near = sketches.approx_coverage(a, b, "k").first()
    for name, exact in (("keys_a", 120_000), ("keys_b", 160_000), ("shared", 30_000), ("only_a", 90_000), ("only_b", 130_000)):
        assert near[name] == pytest.approx(exact, abs=0.04 * 160_000)
    per = {r["d"]: r["keys"] for r in sketches.approx_keys_per_dim(a, "k", "d").collect()}
    assert all(per[d] == pytest.approx(40_000, rel=0.04) for d in range(3))
    parts = [sketches.distinct_sketches(a.filter(F.col("d") == d), "k") for d in range(3)]
    whole = sketches.merged(parts[0].unionByName(parts[1]).unionByName(parts[2])).select(F.theta_sketch_estimate("sketch")).first()[0]
    assert whole == pytest.approx(120_000, rel=0.04)
    assert sketches.approx_coverage(a.filter("false"), b, "k").first()["shared"] == 0


def test_extrema_and_runs_in_one_order(spark):
    rng = np.random.default_rng(9)
    data = [rng.integers(0, 4, n).astype(float) for n in (1, 2, 3, 30, 80)] + [np.ones(6)]
    marked = mark_extrema(series(spark, *data), "key", "t", "x")
    got = {(r["key"], r["t"]): r["is_peak"] - r["is_trough"] for r in marked.collect() if r["is_peak"] or r["is_trough"]}
    want = {}
    for k, x in enumerate(data):
        edges = [0, *(np.flatnonzero(np.diff(x)) + 1), len(x)]
        for a, lo, hi, b in zip(edges, edges[1:], edges[2:], edges[3:]):
            if x[lo] > x[a] and x[lo] > x[hi] or x[lo] < x[a] and x[lo] < x[hi]:
                want[k, (lo + hi - 1) // 2] = 1 if x[lo] > x[a] else -1
    assert got == want
    kinds = ["zero", "season", "increase"]
    flags = spark.createDataFrame([(k, t, kinds[int(rng.integers(3)) if rng.random() < 0.3 else 0]) for k in range(20) for t in range(60) if rng.random() < 0.6],
                                  "key int, t int, type string")
    for n in (2, 3):
        a, b = (sorted(map(tuple, f(flags, "key", "t", offline_from=n).collect())) for f in (collapse_runs, collapse_in_place))
        assert a == b


def test_the_detector_sorts_a_series_few_times(spark):
    found = detect_anomalies(series(spark, *[np.arange(30.0)] * 3), "key")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") <= 4 and plan.count("Exchange hashpartitioning") <= 2


def test_a_hot_key_has_one_row_per_day(spark):
    """A third of the cycles in one key, with many ends per start date."""
    df = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("key"),
        F.date_add(F.lit("2015-01-01").cast("date"), (F.col("id") * 7919 % 300).cast("int")).alias("started"), (F.col("id") % 29).cast("int").alias("n"),
    ).withColumn("ended", F.date_add("started", F.col("n")))
    days = windows.start_days(df, "key", "started", "ended")
    assert days.groupBy("key").count().agg(F.max("count")).first()[0] <= 300
    spans = {r["key"]: r for r in spectral.gap_intervals(df, "key", "started", "ended", "id").collect()}
    pdf = df.toPandas().sort_values(["key", "started", "ended", "id"])
    for key, part in pdf.groupby("key"):
        first, prev, gaps = part["started"].iloc[0], None, []
        for s, e in zip(part["started"], part["ended"]):
            if prev is not None and s > prev:
                gaps.append(((prev - first).days, (s - first).days))
            prev = e
        assert [(g["lo"], g["hi"]) for g in spans[key]["gaps"]] == gaps and spans[key]["length"] == (prev - first).days
        assert spans[key]["cycles"] == len(part)
