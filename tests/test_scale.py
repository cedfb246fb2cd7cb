"""Hot keys, ties and plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spendlens.operators import aggregates, positions, windows
from spendlens.sources import row_range


def hot_rows(spark, n=20_000):
    """A third of the rows in one key, most of them on one day."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 101 + 1)
    day = F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise((F.col("id") * 7919) % 400)
    return spark.range(n).select(
        "id", key.alias("key"), F.date_add(F.lit("2015-01-01").cast("date"), day.cast("int")).alias("started"),
        (F.col("id") % 29).cast("int").alias("len"),
    ).withColumn("ended", F.date_add("started", F.col("len")))


def test_positions_of_a_hot_key(spark):
    df = hot_rows(spark)
    got = positions.keyed_positions(df.select("key", "started", "id"), "key", ["started", "id"])
    pdf = got.toPandas().sort_values(["key", "started", "id"])
    assert (pdf["position"] == pdf.groupby("key").cumcount()).all()
    assert len(pdf) == 20_000


def test_row_range_covers_the_table(spark):
    df = spark.range(5_000).select("id", (F.col("id") * 7919 % 13).alias("v"))
    parts = [row_range(df, lo, 1_500, ["v", "id"]).toPandas() for lo in (0, 1_500, 3_000, 4_500)]
    want = df.toPandas().sort_values(["v", "id"]).reset_index(drop=True)
    for lo, part in zip((0, 1_500, 3_000, 4_500), parts):
        part = part.sort_values(["v", "id"]).reset_index(drop=True)
        assert part.equals(want.iloc[lo:lo + 1_500].reset_index(drop=True))


def test_gaps_of_a_hot_key(spark):
    df = hot_rows(spark, 6_000)
    got = windows.cycle_gaps(df, "key", id_="id").select("id", "gap", "running").toPandas().set_index("id")
    pdf = df.toPandas().sort_values(["key", "started", "ended", "id"])
    prev = pdf.groupby("key")["ended"].shift()
    gap = [0 if p != p or p is None else (s - p).days for s, p in zip(pdf["started"], prev)]
    assert (got.loc[pdf["id"], "gap"].to_numpy() == gap).all()
    lengths = [(e - s).days + g for s, e, g in zip(pdf["started"], pdf["ended"], gap)]
    pdf["run"] = lengths
    assert (got.loc[pdf["id"], "running"].to_numpy() == pdf.groupby("key")["run"].cumsum().to_numpy()).all()


@pytest.mark.parametrize("accuracy", [50, 100_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.zeros(3_000), rng.normal(size=4_001), [1e18, -1e18]])
    df = spark.createDataFrame([(float(v), float(i)) for i, v in enumerate(values)], "a double, b double")
    got = {(r["column"], r["prob"]): r["value"] for r in aggregates.exact_quantiles(df, ["a", "b"], accuracy=accuracy).collect()}
    for p in (0.25, 0.5, 0.75):
        assert got["a", p] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert got["b", p] == pytest.approx(np.quantile(np.arange(len(values)), p))


def test_sampled_keys_are_whole_and_repeatable(spark):
    from spendlens.operators.clean import sample_keys
    df = hot_rows(spark, 3_000)
    one, two = (sample_keys(df, "key", 5, seed=3).toPandas() for _ in range(2))
    assert sorted(one["id"]) == sorted(two["id"])
    assert one["key"].nunique() == 5
    sizes = df.groupBy("key").count().toPandas().set_index("key")["count"]
    assert (one.groupby("key").size() == sizes.loc[sorted(one["key"].unique())]).all()


PLAIN = [n for n in entry.queries() if re.match(r"^[PJAWRU]\d", n)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_join_and_no_python(name, spark, small):
    plan = plan_of(entry.queries()[name](spark, small))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert node not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = plan_of(entry.queries()["P21_between_timestamps"](spark, small))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp\w*>", plan)


def test_detector_gathers_a_series_once(spark, small):
    plan = plan_of(entry.queries()["C4_anomalies_of_customers"](spark, small))
    # totals per month, series per key, and once more behind the Arrow step
    assert len(re.findall(r"\bExchange\b", plan)) <= 3
    assert plan.count("FileScan parquet") == 1


def test_hot_key_join_is_split(spark):
    """With sort-merge joins, the adaptive planner cuts the partition of the hot key."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        # several map tasks, so that there are pieces to split by
        rows = hot_rows(spark, 60_000).repartition(12, "id").withColumn("x", F.hash("id").cast("double"))
        df = aggregates.count_outliers(rows, "key", "x", 1.0)
        got = {r["key"]: r["outliers"] for r in df.collect()}
        assert "skew=true" in plan_of(df)
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    pdf = rows.toPandas()
    for key, part in pdf.groupby("key"):
        limit = part["x"].mean() + part["x"].std(ddof=0)
        assert got[key] == int((part["x"].abs() >= limit).sum())


def test_keyed_positions_keep_rows_without_a_key(spark):
    from spendlens.operators.positions import keyed_positions

    df = spark.createDataFrame([(None, 3), ("a", 2), (None, 1), ("a", 5)], "k string, v int")
    got = {tuple(r) for r in keyed_positions(df, "k", ["v"], "at").select("k", "v", "at").collect()}
    assert got == {(None, 1, 0), (None, 3, 1), ("a", 2, 0), ("a", 5, 1)}
