"""Documented examples with known results."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.operators import anomaly, buckets, clean, spectral, windows
from spendlens.plans import anomalies, clean_cycles


def series(spark, *rows):
    """One key per list of values."""
    data = [(k, t, float(x)) for k, xs in enumerate(rows) for t, x in enumerate(xs)]
    return spark.createDataFrame(data, "key long, t int, x double")


def test_first_of_consecutive_integers(spark):
    vals = [1, 4, 5, 6, 10, 15, 16, 17, 18, 22, 25, 26, 27, 28]
    df = spark.createDataFrame([(1, v) for v in vals], "key int, val int")
    rows = windows.consecutive_groups(df, "key", "val").orderBy("val").collect()
    assert [r["val"] for r in rows] == [1, 4, 10, 15, 22, 25]
    assert [r["val"] for r in rows if r["is_long"]] == [4, 15, 25]


def flags(spark, *pairs):
    return spark.createDataFrame([(1, t, kind, 0.0) for t, kind in pairs], "key int, t int, type string, ratio double")


@pytest.mark.parametrize("collapse", [anomaly.collapse_runs, anomaly.collapse_in_place])
def test_zero_runs_become_offline(spark, collapse):
    df = flags(spark, *[(t, "zero") for t in (1, 2, 3, 5, 6, 10)])
    got = {(r["t"], r["type"]) for r in collapse(df, "key").collect()}
    assert got == {(1, "offline"), (5, "offline"), (10, "zero")}


@pytest.mark.parametrize("collapse", [anomaly.collapse_runs, anomaly.collapse_in_place])
def test_other_type_between_zeros_splits_them(spark, collapse):
    df = flags(spark, (1, "zero"), (2, "increase"), (3, "zero"))
    got = {(r["t"], r["type"]) for r in collapse(df, "key").collect()}
    assert got == {(1, "zero"), (2, "increase"), (3, "zero")}


def test_collapse_without_relabel(spark):
    df = flags(spark, *[(t, "zero") for t in (1, 2, 3, 5, 6, 10)])
    got = {(r["t"], r["type"]) for r in anomaly.collapse_runs(df, "key", relabel=False).collect()}
    assert got == {(1, "zero"), (5, "zero"), (10, "zero")}


def test_collapse_twice_changes_nothing_but_zeros(spark):
    df = flags(spark, (1, "increase"), (2, "increase"), (4, "decrease"), (6, "season"))
    once = anomaly.collapse_runs(df, "key")
    assert set(map(tuple, once.collect())) == set(map(tuple, anomaly.collapse_runs(once, "key").collect()))


def test_adjacent_runs_drop_trailing_flag_after_offline(spark):
    df = flags(spark, (0, "increase"), (2, "zero"), (5, "zero"), (9, "zero"), (11, "decrease"))
    got = [(r["t"], r["type"]) for r in anomaly.collapse_runs(df, "key", mode="adjacent").orderBy("t").collect()]
    assert got == [(0, "increase"), (2, "offline")]


def test_trims(spark):
    xs = [0] * 7 + list(range(1, 10)) + [0] * 11
    df = series(spark, xs, [0, 0, 0])
    out = windows.trim_trailing_zeros(windows.trim_leading_zeros(df, "key", "t", "x"), "key", "t", "x")
    rows = out.orderBy("key", "t").collect()
    assert [r["x"] for r in rows if r["key"] == 0] == list(range(1, 10))
    assert len([r for r in rows if r["key"] == 1]) == 3


def test_peaks_with_plateaus(spark):
    df = series(spark, [0, 1, 1, 1, 0, 2, 0, 3, 3, 1, 4], [5, 1, 1, 5], [1, 1, 1], [2])
    got = anomaly.find_peaks(df, "key").orderBy("key", "t").collect()
    assert [(r["key"], r["t"]) for r in got] == [(0, 2), (0, 5), (0, 7)]
    low = anomaly.find_peaks(df, "key", sign=-1).orderBy("key", "t").collect()
    assert [(r["key"], r["t"]) for r in low] == [(0, 4), (0, 6), (0, 9), (1, 1)]


def test_period_of_a_sine(spark):
    df = series(spark, np.sin(2 * np.pi * np.arange(40) / 4))
    row = spectral.dominant_period(df, "key", variant="raw").first()
    assert (row["nfft"], row["bin"], row["period"]) == (64, 16, 3.875)
    assert spectral.dominant_period(df, "key").first()["period"] == 4.0
    long = series(spark, np.sin(2 * np.pi * np.arange(120) / 4))
    row = spectral.dominant_period(long, "key", variant="raw").first()
    assert (row["nfft"], row["bin"], row["period"]) == (128, 32, 3.9375)


def test_short_and_flat_series_have_no_period(spark):
    df = series(spark, [1], [1, 2], [0, 0, 0, 0], [7, 7, 7, 7, 7])
    got = {r["key"]: r["period"] for r in spectral.dominant_period(df, "key").collect()}
    assert got == {0: 1000.0, 1: 1000.0, 2: 1000.0, 3: 1000.0}
    tested = spectral.seasonal_slope_of_arrays(spectral.series_arrays(df, "key"), "key").collect()
    assert {r["key"] for r in tested} == {0, 1, 2, 3}


def cycles_of(spark, *rows, day="2015-01-01"):
    base = dt.date.fromisoformat(day)
    data = [(i, 1, base + dt.timedelta(a), base + dt.timedelta(b)) for i, (a, b) in enumerate(rows)]
    return spark.createDataFrame(data, "cycle_id long, master_id long, started date, ended date")


@pytest.mark.parametrize("mode, gap", [("exact", range(10, 15)), ("legacy", range(25, 30))])
def test_gap_position(spark, mode, gap):
    df = cycles_of(spark, (0, 10), (15, 25), (25, 35))
    rows = spectral.gap_series(df, "master_id", mode=mode).orderBy("t").collect()
    assert len(rows) == 35
    assert [r["t"] for r in rows if r["x"] == 0] == list(gap)


def test_gaps_and_copies(spark):
    df = cycles_of(spark, (0, 10), (0, 10), (8, 12), (20, 21))
    rows = windows.cycle_gaps(df, "master_id").orderBy("cycle_id").collect()
    assert [r["gap"] for r in rows] == [0, -10, -2, 8]
    assert [r["running"] for r in rows] == [10, 10, 12, 21]


def test_prorated_example(spark):
    df = spark.createDataFrame([("a", dt.date(2015, 1, 10), dt.date(2015, 2, 20), 1.0)],
                               "k string, started date, ended date, budget double")
    feb = 2015 * 12 + 1
    for mode, want in (("overlap", 19 / 28), ("legacy", 41 / 28)):
        df2 = df.withColumn("budget", F.lit(1000.0))
        out = buckets.prorate(df2, ["k"], "month", mode=mode).where(F.col("bucket_idx") == feb).first()
        assert out["value"] == pytest.approx(1000 * want)


def test_overlap_days_add_up_to_the_cycle(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2015, 1, 10), dt.date(2015, 12, 31), 365.0), ("b", dt.date(2014, 12, 31), dt.date(2015, 3, 1), 100.0)],
        "k string, started date, ended date, budget double")
    from spendlens.functions import bucket_days
    out = buckets.prorate(df, ["k"], "month").withColumn(
        "days", F.col("value") * bucket_days(F.col("bucket_idx"), "month"))
    got = {r["k"]: r["d"] for r in out.groupBy("k").agg(F.sum("days").alias("d")).collect()}
    assert got["a"] == pytest.approx(365.0 * 355)
    assert got["b"] == pytest.approx(100.0 * 60)


def test_matrix_has_every_key_and_bucket(spark):
    from spendlens.plans import budget_matrix
    df = spark.createDataFrame(
        [("a", dt.date(2015, 1, 1), dt.date(2015, 3, 31), 10.0), ("a", dt.date(2015, 3, 31), dt.date(2015, 1, 1), 20.0),
         (None, dt.date(2015, 1, 1), dt.date(2015, 12, 31), 5.0)],
        "category string, started date, ended date, budget double")
    for agg in ("mean", "sum", "prorated"):
        out = budget_matrix(df, "category", "quarter", 2015 * 4, 2015 * 4 + 3, agg)
        assert out.count() == 8
        assert {r["category"] for r in out.collect()} == {"a", "Other"}
    mean = budget_matrix(df, "category", "quarter", 2015 * 4, 2015 * 4 + 3, wide=True).orderBy("category").collect()
    assert [tuple(r)[1:] for r in mean] == [(0.0, 0.0, 0.0, 0.0), (15.0, 0.0, 0.0, 0.0)]


def test_clean_cycles(spark):
    d = dt.date
    rows = [
        (1, 1, "x", 100.0, d(2015, 1, 1), d(2015, 1, 31)),
        (2, 1, "x", 100.0, d(2015, 3, 2), d(2015, 2, 1)),   # reversed, 29 days
        (3, 1, "x", 0.5, d(2015, 1, 1), d(2015, 1, 31)),    # below 1
        (4, 1, "x", None, d(2015, 1, 1), d(2015, 1, 31)),   # missing budget stays
        (5, 1, "x", 10.0, d(2018, 12, 31), None),           # cut-off day
        (6, 1, "x", 10.0, d(2016, 1, 1), None),             # rebuilt end
        (7, 2, None, 10.0, d(2016, 1, 1), d(2016, 1, 9)),   # missing offer: whole advertiser
        (8, 2, "x", 10.0, d(2016, 1, 1), d(2016, 1, 9)),
        (9, 3, "x", 10.0, None, d(2016, 1, 9)),             # missing start: whole advertiser
        (10, 3, "x", 10.0, d(2016, 1, 1), d(2016, 1, 9)),
    ]
    df = spark.createDataFrame(
        rows, "cycle_id long, master_id long, offer_name string, budget double, started date, ended date")
    out = {r["cycle_id"]: r for r in clean_cycles(df, "2018-12-31").collect()}
    assert set(out) == {1, 2, 4, 6}
    assert (out[2]["started"], out[2]["ended"], out[2]["duration"]) == (d(2015, 2, 1), d(2015, 3, 2), 29)
    assert (out[6]["ended"], out[6]["duration"]) == (d(2016, 1, 31), 30)


def test_marker_rows(spark):
    df = spark.createDataFrame([("a", "1"), ("\\N", "2"), (None, "3"), ("b", "\\N")], "s string, n string")
    assert {r["n"] for r in clean.drop_marker_rows(df).collect()} == {"1", "3"}
    assert clean.promote_numeric(spark.createDataFrame([("a", "1"), ("b", None)], "s string, n string")).dtypes == [
        ("s", "string"), ("n", "double")]


def test_matrix_row_detector(spark):
    xs = [0.0, 0.0] + [100.0, 200.0, 300.0, 200.0] * 6 + [0.0, 0.0, 0.0]
    names = [f"c{i}" for i in range(len(xs))]
    wide = spark.createDataFrame([(1, *xs)], ["key", *names])
    out = anomalies.detect_anomalies(anomalies.series_from_matrix(wide, "key"), "key").orderBy("idx").collect()
    assert {r["period"] for r in out} == {4.0}
    # index counts from the first non-zero month
    assert (24, "offline") in {(r["idx"], r["type"]) for r in out}
    lists = anomalies.anomaly_lists(anomalies.detect_anomalies(anomalies.series_from_matrix(wide, "key"), "key"), "key")
    row = lists.first()
    assert row["flags"] == sorted(row["flags"]) and len(row["flags"]) == len(row["types"]) == len(row["ratios"])
