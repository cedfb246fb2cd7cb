"""Sizes of tasks and of batches, and gap series that overlap."""

import random

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from spendlens.operators import spectral


@pytest.mark.parametrize("name", ["C4_anomalies_of_customers", "C4_anomalies_adjacent_runs", "T19_collapse_adjacent", "W8_run_length",
                                  "C3_seasonality_by_ks_test", "R8_metric_series", "A1_sum_by_key"])
def test_a_query_bounds_the_bytes_of_a_task(spark, small, name):
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m", "spark.sql.files.maxPartitionBytes": "128m"}
    before = {n: spark.conf.get(n, None) for n in settings}
    try:
        for n, v in settings.items():
            spark.conf.set(n, v)
        entry.queries()[name](spark, small)
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "1m"
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_pieces_of_a_batch_are_bounded(monkeypatch):
    monkeypatch.setattr(spectral, "CELLS", 100)
    rng = np.random.default_rng(2)
    batch = pd.Series([None if i % 7 == 0 else rng.normal(size=rng.integers(0, 60)) for i in range(200)], dtype=object)
    pieces = list(spectral.pieces_of(batch))
    assert [id(v) for p in pieces for v in p] == [id(v) for v in batch]
    assert max(sum(len(v) for v in p.iloc[1:] if v is not None) for p in pieces) <= 100
    assert list(spectral.pieces_of(batch.iloc[:0])) == []


def test_spectra_of_pieces_are_those_of_the_batch(spark, small):
    from spendlens.frames import supplier_series

    df = spectral.series_arrays(supplier_series(spark, small), "key")
    got = {r["key"]: r["ps"] for r in df.select("key", spectral.half_power(df["xs"], 4).alias("ps")).collect()}
    for r in df.collect():
        powers, flat = spectral.scaled_powers(np.array([r["xs"]]), 4)
        assert got[r["key"]] is None if flat[0] else np.allclose(got[r["key"]], powers[0], rtol=0, atol=1e-12)


def test_overlapping_gaps_are_laid_down_once(spark):
    rng, rows = random.Random(1), []
    for k in range(200):
        starts = [rng.randint(-2, 60) for _ in range(rng.randint(0, 8))]
        rows.append((k, rng.choice([-3, 0, 1, 5, 30, 80]), sorted((lo, lo + rng.randint(1, 30)) for lo in starts)))
    df = spark.createDataFrame(rows, "k int, length int, gaps array<struct<lo:int,hi:int>>")
    out = spectral.gap_arrays(df, "legacy")
    got = {r["k"]: r["xs"] for r in out.collect()}
    for k, n, gaps in rows:
        assert got[k] == [0.0 if any(a <= t < b for a, b in gaps) else 1.0 for t in range(n)]
    # no day is compared with every gap
    assert "exists(" not in out._jdf.queryExecution().optimizedPlan().toString()
