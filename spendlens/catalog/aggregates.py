"""Aggregates, profiles, sorts and limits."""

from pyspark.sql import functions as F

from .. import frames
from ..frames import CYCLES_SQL, MART_SQL, SEGMENT_SQL, SUMMARY_SQL, cycles, mart_rows, segment_series, summary, table
from ..functions.numbers import exact_avg
from ..operators import aggregates as A
from ..operators.joins import drop_keys
from ..operators.clean import order_dates, with_duration
from ..plans.churn import TYPE_PAIRS
from ..plans.rollup import campaign_rollup
from .joins import COMMENTS_SQL
from .projections import DURATIONS
from . import query

M = "with " + MART_SQL + " "


@query("A1_sum_by_key", M + """
select idadvertiser, csr_year, csr_month, cast(sum(cast(spend as decimal(18,2))) as double) as spend from mart
group by all""")
def a1(spark, sf):
    return A.sum_by(mart_rows(spark, sf), ["idadvertiser", "csr_year", "csr_month"], "spend", "spend")


@query("A2_mean_by_key", "with " + CYCLES_SQL + """
select category, cast(sum(cast(budget as decimal(18,2))) as double) / count(budget) as mean_budget from cycles
where category is not null group by 1""")
def a2(spark, sf):
    return cycles(spark, sf).where(F.col("category").isNotNull()).groupBy("category").agg(
        exact_avg(F.col("budget")).alias("mean_budget"))


@query("A3_mean_of_all_numeric", """
select o_custkey, cast(sum(o_orderkey) as double) / count(o_orderkey) as o_orderkey,
  cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(o_totalprice) as o_totalprice from orders group by 1""")
def a3(spark, sf):
    return A.mean_all(table(spark, sf, "orders"), "o_custkey", money=("o_totalprice",))


@query("A4_min_max", "with " + CYCLES_SQL + """
select master_id, min(budget) as lo, max(budget) as hi, coalesce(cast(min(started) as varchar), '') as first_start
from cycles group by 1""")
def a4(spark, sf):
    return cycles(spark, sf).groupBy("master_id").agg(
        F.min("budget").alias("lo"), F.max("budget").alias("hi"),
        F.coalesce(F.min("started").cast("string"), F.lit("")).alias("first_start"))


@query("A4_year_span_per_key", M + "select idadvertiser, min(csr_year) as first_year, max(csr_year) as last_year from mart group by 1")
def a4_span(spark, sf):
    return mart_rows(spark, sf).groupBy("idadvertiser").agg(
        F.min("csr_year").alias("first_year"), F.max("csr_year").alias("last_year"))


@query("A5_distinct_count", M + """
select count(distinct idadvertiser) as advertisers, count(distinct idcampaign_master) as masters,
  count(distinct stop_request) as requests from mart""")
def a5(spark, sf):
    return mart_rows(spark, sf).agg(
        F.countDistinct("idadvertiser").alias("advertisers"), F.countDistinct("idcampaign_master").alias("masters"),
        F.countDistinct("stop_request").alias("requests"))


@query("A6_multi_aggregate_rollup", M + """
select idadvertiser, idcampaign_master, idcampaign, cast(sum(clicks) as bigint) as clicks, cast(sum(calls) as bigint) as calls,
  cast(sum(impressions) as bigint) as impressions, cast(coalesce(sum(stop_request), 0) as bigint) as stop_request,
  max(csr_year) as csr_year from mart group by 1, 2, 3""")
def a6(spark, sf):
    return campaign_rollup(
        mart_rows(spark, sf), ("idadvertiser", "idcampaign_master", "idcampaign"),
        ("clicks", "calls", "impressions", "stop_request"), "csr_year")


@query("A7_conditional_sum", "with " + COMMENTS_SQL + """
select idcampaign, count(*) filter (user_id <> 1) as businessuser, count(*) filter (user_id = 1) as system
from comments group by 1""")
def a7(spark, sf):
    return frames.comments(spark, sf).groupBy("idcampaign").agg(
        F.count_if(F.col("user_id") != 1).alias("businessuser"), F.count_if(F.col("user_id") == 1).alias("system"))


@query("A8_any_match_flag", "with " + COMMENTS_SQL + """
select idcampaign, cast(year(cc_entered) as int) as cc_year, max(case when cc_comment like '*USER STOP REQUEST*%' then 1 else 0 end)
  as stop_request from comments group by all""")
def a8(spark, sf):
    stop = F.col("cc_comment").like("*USER STOP REQUEST*%")
    return frames.comments(spark, sf).groupBy("idcampaign", F.year("cc_entered").alias("cc_year")).agg(
        F.max(F.when(stop, 1).otherwise(0)).alias("stop_request"))


@query("A9_loose_group_by", M + """
select csr_year, csr_month, idcampaign, min(advertiser_name) as advertiser_name, min(adv_change_type) as adv_change_type,
  min(idoffer) as idoffer from mart group by 1, 2, 3""")
def a9(spark, sf):
    return mart_rows(spark, sf).groupBy("csr_year", "csr_month", "idcampaign").agg(
        *[F.min(c).alias(c) for c in ("advertiser_name", "adv_change_type", "idoffer")])


@query("A10_group_by_expression", """
select cast(year(l_shipdate) as int) as adv_year, cast(month(l_shipdate) as int) as adv_month, count(*) as n from lineitem
where l_returnflag = 'R' group by 1, 2""")
def a10(spark, sf):
    return frames.transfer_log(spark, sf).groupBy(
        F.year("created").alias("adv_year"), F.month("created").alias("adv_month")).agg(F.count("*").alias("n"))


@query("A11_value_counts", M + "select idcampaign_master, count(*) as n from mart group by 1 order by n desc, 1")
def a11(spark, sf):
    return A.value_counts(mart_rows(spark, sf), "idcampaign_master")


@query("A12_mode", DURATIONS + "select cast(duration as bigint) as duration from usual")
def a12(spark, sf):
    return A.mode_of(with_duration(order_dates(cycles(spark, sf))), "duration")


PROFILE_COLS = ("l_quantity", "l_extendedprice", "l_discount")


@query("A13_profile", " union all ".join(f"""
select '{c}' as "column", count({c}) as "count", cast(sum(cast({c} as decimal(18,2))) as double) / count({c}) as mean, round(stddev_samp({c}), 4) as std,
  min({c}) as "min", quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50, quantile_cont({c}, 0.75) as q75,
  max({c}) as "max" from lineitem""" for c in PROFILE_COLS))
def a13(spark, sf):
    return A.profile(table(spark, sf, "lineitem"), list(PROFILE_COLS), money=PROFILE_COLS).withColumn(
        "std", F.round("std", 4))


@query("A14_null_profile", "with " + CYCLES_SQL + " " + " union all ".join(
    f"select '{c}' as \"column\", count(*) filter ({c} is null) as missing from cycles" for c in
    ("cycle_id", "category", "offer_name", "budget", "started", "ended", "short_end")))
def a14(spark, sf):
    return A.null_profile(cycles(spark, sf).select(
        "cycle_id", "category", "offer_name", "budget", "started", "ended", "short_end"))


@query("A15_marker_profile", """
select 'o_orderstatus' as "column", count(*) filter (o_orderstatus = 'P') as marked from orders
union all select 'o_orderpriority', count(*) filter (o_orderpriority = 'P') from orders
union all select 'o_orderkey', 0 from orders group by 1""")
def a15(spark, sf):
    return A.marker_profile(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "P")


@query("A16_keys_per_dimension", M + "select adv_change_type, count(distinct idadvertiser) as keys from mart group by 1")
def a16(spark, sf):
    return A.keys_per_dim(mart_rows(spark, sf), "idadvertiser", "adv_change_type")


@query("A17_ambiguous_keys", M + """
select idcampaign_master, count(distinct adv_change_type) as "values" from mart group by 1 having count(distinct adv_change_type) > 1""")
def a17(spark, sf):
    return A.ambiguous_keys(mart_rows(spark, sf), "idcampaign_master", "adv_change_type")


@query("A18_ever_counts", M + """
select t as adv_change_type, cast(sum(hit) as bigint) as keys from (
  select idadvertiser, t, max(case when adv_change_type = t then 1 else 0 end) as hit
  from mart cross join (select unnest(['Idle down', 'Idle up', 'Change up', 'Change down']) as t) group by all) group by 1""")
def a18(spark, sf):
    return A.ever_counts(mart_rows(spark, sf), "idadvertiser", "adv_change_type",
                         ["Idle down", "Idle up", "Change up", "Change down"])


def _pair_sql(a, b):
    return f"""select '{a}' as first, '{b}' as second,
  count(*) filter (list_contains(ts, '{a}') and list_contains(ts, '{b}')) as "both",
  count(*) filter (list_contains(ts, '{a}') or list_contains(ts, '{b}')) as either from sets"""


@query("A19_cooccurrence", M + ", sets as (select idadvertiser, list(distinct adv_change_type) as ts from mart group by 1) "
       + " union all ".join(_pair_sql(a, b) for a, b in TYPE_PAIRS))
def a19(spark, sf):
    return A.cooccurrence(mart_rows(spark, sf), "idadvertiser", "adv_change_type", list(TYPE_PAIRS))


@query("A20_key_share", "with " + CYCLES_SQL + """
select count(distinct case when ended is null then master_id end) as keys_hit, count(distinct master_id) as keys,
  100.0::double * count(distinct case when ended is null then master_id end) / count(distinct master_id) as percent from cycles""")
def a20(spark, sf):
    return A.key_share(cycles(spark, sf), "master_id", F.col("ended").isNull())


@query("A21_zero_total_keys", """
select l_orderkey, l_linenumber, l_discount from lineitem where l_orderkey not in (
  select l_orderkey from lineitem group by 1 having sum(cast(l_discount as decimal(18,2))) = 0)""")
def a21(spark, sf):
    rows = table(spark, sf, "lineitem")
    return drop_keys(rows, A.zero_total_keys(rows, "l_orderkey", "l_discount"), "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_discount")


@query("A22_histogram", """
select cast(least(floor((x - lo) / w), 9) as bigint) as bin, count(*) as n from (
  select o_totalprice as x, (select min(o_totalprice) from orders) as lo,
    ((select max(o_totalprice) from orders) - (select min(o_totalprice) from orders)) / 10 as w from orders) group by 1""")
def a22(spark, sf):
    return A.histogram(table(spark, sf, "orders"), "o_totalprice", 10)


@query("A23_series_deviation", """
select user_id, round(stddev_pop(value), 4) as std_pop, round(stddev_samp(value), 4) as std_samp from events group by 1""")
def a23(spark, sf):
    return A.series_std(table(spark, sf, "events"), "user_id", "value").select(
        "user_id", F.round("std_pop", 4).alias("std_pop"), F.round("std_samp", 4).alias("std_samp"))


@query("A24_argmax", "with " + SEGMENT_SQL + " select key, max(x) as x, arg_max(t, x) as t from (select * from series order by key, t) group by 1")
def a24(spark, sf):
    return A.argmax(segment_series(spark, sf), "key", "x", "t")


@query("A25_outlier_count", """
select l_suppkey, count(*) filter (abs(l_quantity) >= m + 1.5 * s) as outliers from lineitem
join (select l_suppkey, avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem group by 1) using (l_suppkey) group by 1""")
def a25(spark, sf):
    return A.count_outliers(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", 1.5)


@query("A26_first_row_by_time", """
select o_custkey, o_orderkey, o_orderpriority from orders
qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1""")
def a26(spark, sf):
    return A.first_by(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"],
                      ["o_orderkey", "o_orderpriority"])


@query("A27_shape", "select count(*) as n_rows, cast(11 as bigint) as n_cols from lineitem")
def a27(spark, sf):
    return A.shape(table(spark, sf, "lineitem"))


@query("L1_multi_key_sort", "select o_custkey, o_orderkey from orders order by o_custkey, o_orderkey desc")
def l1(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey").orderBy("o_custkey", F.desc("o_orderkey"))


@query("L2_head_and_tail", """
select 'head' as part, o_orderkey from (select o_orderkey from orders order by o_totalprice, o_orderkey limit 15)
union all select 'tail', o_orderkey from (select o_orderkey from orders order by o_totalprice desc, o_orderkey desc limit 15)""")
def l2(spark, sf):
    rows = table(spark, sf, "orders")
    head = rows.orderBy("o_totalprice", "o_orderkey").limit(15)
    tail = rows.orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(15)
    return head.select(F.lit("head").alias("part"), "o_orderkey").unionByName(
        tail.select(F.lit("tail").alias("part"), "o_orderkey"))


@query("L3_limit", "select event_id, event_type from events where event_type <> 'view' order by event_id limit 1000")
def l3(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type") != "view").select("event_id", "event_type").orderBy(
        "event_id").limit(1000)


@query("L4_top_k_values", "select l_partkey, count(*) as n from lineitem group by 1 order by n desc, 1 limit 25")
def l4(spark, sf):
    return A.top_k(table(spark, sf, "lineitem"), "l_partkey", 25)


@query("L6_smallest_key_per_group", "with " + SUMMARY_SQL + """
select idbusiness, min(idcampaign_master) as idcampaign_master from summary group by 1""")
def l6(spark, sf):
    return summary(spark, sf).groupBy("idbusiness").agg(F.min("idcampaign_master").alias("idcampaign_master"))
