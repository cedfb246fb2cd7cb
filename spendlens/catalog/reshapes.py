"""Buckets, matrices and reshaping."""

from pyspark.sql import functions as F

from ..frames import (
    CYCLES_SQL, FIRST_QUARTER, LAST_QUARTER, FIRST_MONTH, LAST_MONTH, MART_SQL, SEGMENT_SQL, cycles, mart_rows,
    segment_series, table,
)
from ..functions.dates import label_of
from ..operators import buckets as B
from ..operators.aggregates import profile
from ..operators.clean import order_dates
from . import query

IDX = {"quarter": "year({0}) * 4 + quarter({0}) - 1", "month": "year({0}) * 12 + month({0}) - 1"}
START = {"quarter": "make_date({0} // 4, ({0} % 4) * 3 + 1, 1)", "month": "make_date({0} // 12, {0} % 12 + 1, 1)"}

ORDERED_SQL = CYCLES_SQL + """,
ordered as (select cycle_id, master_id, coalesce(category, 'Other') as category, budget,
    least(started, short_end) as s, greatest(started, short_end) as e
  from cycles where started is not null and short_end is not null)"""


def ordered_cycles(spark, sf):
    rows = cycles(spark, sf).na.fill({"category": "Other"})
    return order_dates(rows, "started", "short_end").where(
        F.col("started").isNotNull() & F.col("short_end").isNotNull())


@query("J10_bucket_contained", "with " + ORDERED_SQL + f"""
select cycle_id, {IDX['quarter'].format('s')} as bucket_idx from ordered
where date_trunc('quarter', s) = date_trunc('quarter', e)""")
def j10(spark, sf):
    return B.bucket_contained(ordered_cycles(spark, sf), "quarter", "started", "short_end").select(
        "cycle_id", F.col("bucket_idx").cast("long"))


def spread_sql(grain):
    """Cycles joined to every bucket they touch, by comparing dates with bucket limits."""
    i = START[grain]
    return ORDERED_SQL + f""",
spine as (select b, {i.format('b')} as lo, {i.format('(b + 1)')} as nxt
  from (select unnest(range(1990 * {4 if grain == 'quarter' else 12}, 2010 * {4 if grain == 'quarter' else 12})) as b)),
touched as (select o.*, p.b as bucket_idx, p.lo, p.nxt from ordered o join spine p on o.s < p.nxt and o.e >= p.lo)"""


@query("J11_bucket_overlap", "with " + spread_sql("month") + " select cycle_id, bucket_idx from touched")
def j11(spark, sf):
    return B.bucket_overlap(ordered_cycles(spark, sf), "month", "started", "short_end").select(
        "cycle_id", F.col("bucket_idx").cast("long"))


LEGACY_END = "case when month(lo) = 12 then nxt - 1 else nxt end"
LEGACY = f""", bounded as (select *, cast({LEGACY_END} as date) as hi from touched),
legacy as (select * from bounded where (s >= lo and e < hi) or (s >= lo and s < hi and e > hi) or (e >= lo and e < hi and s < lo))"""


@query("J11_bucket_overlap_legacy", "with " + spread_sql("month") + LEGACY + " select cycle_id, bucket_idx from legacy")
def j11_legacy(spark, sf):
    return B.bucket_overlap(ordered_cycles(spark, sf), "month", "started", "short_end", mode="legacy").select(
        "cycle_id", F.col("bucket_idx").cast("long"))


MONEY_MEAN = "cast(sum(cast(budget as decimal(18,2))) as double) / count(budget)"


@query("J12_densify", "with " + ORDERED_SQL + f""",
v as (select category, {IDX['quarter'].format('s')} as b, {MONEY_MEAN} as value from ordered
  where date_trunc('quarter', s) = date_trunc('quarter', e) group by all)
select k.category, cast(g.b as bigint) as bucket_idx, coalesce(v.value, 0.0) as value
from (select distinct category from ordered) k cross join (select unnest(range({FIRST_QUARTER - 4}, {LAST_QUARTER + 5})) as b) g
left join v on v.category = k.category and v.b = g.b""")
def j12(spark, sf):
    rows = ordered_cycles(spark, sf)
    tagged = B.bucket_contained(rows, "quarter", "started", "short_end", keep_all=True)
    booked = B.bucket_values(tagged, ["category"], "budget")
    return B.densify(booked, "category", FIRST_QUARTER - 4, LAST_QUARTER + 4).select(
        "category", F.col("bucket_idx").cast("long"), "value")


def matrix_cells(grain, first, last):
    return ", ".join(
        f"coalesce(max(value) filter (b = {i}), 0.0) as \"{label_of(i, grain)}\"" for i in range(first, last + 1))


@query("R1_long_to_wide_matrix", "with " + ORDERED_SQL + f""",
v as (select category, {IDX['month'].format('s')} as b, {MONEY_MEAN} as value from ordered
  where date_trunc('month', s) = date_trunc('month', e) group by all)
select category, {matrix_cells('month', FIRST_MONTH, LAST_MONTH)} from v group by 1""")
def r1(spark, sf):
    booked = B.bucket_values(
        B.bucket_contained(ordered_cycles(spark, sf), "month", "started", "short_end"), ["category"], "budget")
    return B.to_matrix(booked, "category", "month", FIRST_MONTH, LAST_MONTH)


@query("R2_wide_to_series", """
select p_partkey as key, cast(t as bigint) as t, x from part,
  (select unnest([0, 1, 2]) as t) g, lateral (select case t when 0 then cast(p_size as double) when 1 then p_retailprice
    else cast(p_partkey as double) end as x)""")
def r2(spark, sf):
    wide = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size", "p_retailprice",
                                           F.col("p_partkey").alias("id"))
    return B.to_series(wide, "key", ["p_size", "p_retailprice", "id"]).select("key", F.col("t").cast("long"), "x")


@query("R3_quarter_profile", "with " + ORDERED_SQL + f""",
y as (select category, year(s) as y, quarter(s) as q, {MONEY_MEAN} as m from ordered
  where date_trunc('quarter', s) = date_trunc('quarter', e) group by all)
select category, """ + ", ".join(
    f"coalesce(list_reduce(list(m order by y) filter (q = {q}), lambda a, b: a + b), 0.0) as q{q}" for q in range(1, 5))
       + " from y group by 1")
def r3(spark, sf):
    return B.quarter_profile(ordered_cycles(spark, sf), "category", "budget", "started", "short_end")


@query("R4_one_hot", """
select o_orderkey, cast(o_orderstatus = 'F' as int) as "o_orderstatus_F", cast(o_orderstatus = 'O' as int) as "o_orderstatus_O",
  cast(o_orderstatus = 'P' as int) as "o_orderstatus_P" from orders""")
def r4(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return B.one_hot(rows, "o_orderstatus", ["F", "O", "P"]).drop("o_orderstatus")


@query("R5_melt", """
select l_orderkey, l_linenumber, 'l_quantity' as "column", l_quantity as value from lineitem
union all select l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice from lineitem
union all select l_orderkey, l_linenumber, 'l_discount', l_discount from lineitem""")
def r5(spark, sf):
    return B.melt(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                  ["l_quantity", "l_extendedprice", "l_discount"])


@query("R6_transposed_profile", " union all ".join(f"""
select '{m}' as measure, cast({e.format('c_acctbal')} as double) as c_acctbal, cast({e.format('c_nationkey')} as double) as c_nationkey from customer"""
       for m, e in (("count", "count({0})"), ("min", "min({0})"), ("q50", "quantile_cont({0}, 0.5)"), ("max", "max({0})"))))
def r6(spark, sf):
    cols = ["c_acctbal", "c_nationkey"]
    marks = ["count", "min", "q50", "max"]
    rows = profile(table(spark, sf, "customer"), cols).select("column", *[F.col(m).cast("double").alias(m) for m in marks])
    long = rows.unpivot("column", marks, "measure", "value")
    return long.groupBy("measure").pivot("column", cols).agg(F.first("value"))


QUARTER_NAMES = [f"{b // 4}-Q{b % 4 + 1}" for b in range(FIRST_QUARTER, LAST_QUARTER + 1)]


@query("R7_index_as_column", "with " + SEGMENT_SQL + " select key as idadvertiser_master, "
       + ", ".join(f'max(x) filter (t = {i}) as "{name}"' for i, name in enumerate(QUARTER_NAMES))
       + " from series group by 1")
def r7(spark, sf):
    return _segment_matrix(spark, sf).withColumnRenamed("key", "idadvertiser_master")


@query("R7_column_as_index", "with " + SEGMENT_SQL
       + f" select key, {QUARTER_NAMES}[t + 1] as quarter, x from series")
def r7_back(spark, sf):
    labelled = r7(spark, sf).withColumnRenamed("idadvertiser_master", "key")
    return B.melt(labelled, ["key"], QUARTER_NAMES, "quarter", "x")


def _segment_matrix(spark, sf):
    booked = segment_series(spark, sf).select(
        "key", (F.col("t") + FIRST_QUARTER).alias("bucket_idx"), F.col("x").alias("value"))
    return B.to_matrix(booked, "key", "quarter", FIRST_QUARTER, LAST_QUARTER)


METRICS = ["clicks", "impressions", "calls"]


@query("R8_metric_series", "with " + MART_SQL + """,
m as (select idadvertiser, csr_year, csr_month, cast(sum(clicks) as double) as clicks, cast(sum(impressions) as double) as impressions,
  cast(sum(calls) as double) as calls from mart group by 1, 2, 3),
p as (select *, row_number() over (partition by idadvertiser order by csr_year, csr_month) - 1 as idx from m)
""" + " union all ".join(f"select idadvertiser, idx, '{m}' as metric, {m} as x from p" for m in METRICS))
def r8(spark, sf):
    return B.metric_series(mart_rows(spark, sf), "idadvertiser", ["csr_year", "csr_month"], METRICS).select(
        "idadvertiser", F.col("idx").cast("long"), "metric", "x")


PRORATED = "cast(sum(cast(budget as decimal(18,2)) * {days}) as double) / {span}"


@query("T32_prorated_budget", "with " + spread_sql("month") + """
select category, bucket_idx, round(cast(sum(cast(budget as decimal(18,2)) * date_diff('day', greatest(s, lo), least(e, nxt))) as double)
  / date_diff('day', any_value(lo), any_value(nxt)), 6) as value from touched group by 1, 2""")
def t32(spark, sf):
    out = B.prorate(ordered_cycles(spark, sf), ["category"], "month", "budget", "started", "short_end")
    return out.select("category", F.col("bucket_idx").cast("long"), F.round("value", 6).alias("value"))


@query("T32_prorated_budget_legacy", "with " + spread_sql("month") + LEGACY + """
select category, bucket_idx, round(cast(sum(cast(budget as decimal(18,2)) * (date_diff('day', lo, hi)
  - (date_diff('day', e, hi) + date_diff('day', lo, s)))) as double) / date_diff('day', any_value(lo), any_value(hi)), 6) as value
from legacy group by 1, 2""")
def t32_legacy(spark, sf):
    out = B.prorate(ordered_cycles(spark, sf), ["category"], "month", "budget", "started", "short_end", mode="legacy")
    return out.select("category", F.col("bucket_idx").cast("long"), F.round("value", 6).alias("value"))
