"""Joins and set operations."""

from pyspark.sql import functions as F

from .. import frames
from ..frames import CYCLES_SQL, MART_SQL, SUMMARY_SQL, cycles, mart_rows, summary, table
from ..operators import joins as J
from ..operators.keyed import aggregate_apart
from . import query

COMMENTS_SQL = """comments as (
  select user_id as idcampaign, case when event_type = 'error' then 1 else 2 end as user_id,
    case when event_type = 'signup' then '*USER STOP REQUEST* ' || props else props end as cc_comment,
    date '1995-01-01' + cast(event_id % 2480 as int) as cc_entered from events)"""


@query("J1_left_join_three_keys", "with " + CYCLES_SQL + ", " + MART_SQL + """
select c.cycle_id, c.budget, coalesce(r.clicks, 0) as clicks
from cycles c left join (select idadvertiser, idcampaign_master, idcampaign, cast(sum(clicks) as bigint) as clicks
  from mart group by all) r using (idadvertiser, idcampaign_master, idcampaign)""")
def j1(spark, sf):
    keys = ["idadvertiser", "idcampaign_master", "idcampaign"]
    rolled = mart_rows(spark, sf).groupBy(*keys).agg(F.sum("clicks").alias("clicks"))
    return J.left_join(cycles(spark, sf), rolled, keys).select(
        "cycle_id", "budget", F.coalesce("clicks", F.lit(0)).alias("clicks"))


@query("J1_left_join_null_safe", "with " + CYCLES_SQL + """
select c.cycle_id, t.n from cycles c left join (select category, offer_name, count(*) as n from cycles group by all) t
  on c.category is not distinct from t.category and c.offer_name is not distinct from t.offer_name""")
def j1_null_safe(spark, sf):
    rows = cycles(spark, sf).select("cycle_id", "category", "offer_name")
    sizes = aggregate_apart(rows, ["category", "offer_name"], F.count("*").alias("n"))
    return J.left_join(rows, sizes, ["category", "offer_name"], null_safe=True).select("cycle_id", "n")


@query("J2_inner_join_chain", "with " + COMMENTS_SQL + """
select c.idcampaign, o.o_custkey as idadvertiser, k.c_name as advertiser_name, count(*) as comments
from comments c join orders o on o.o_orderkey = c.idcampaign join customer k on k.c_custkey = o.o_custkey
group by all""")
def j2(spark, sf):
    per = frames.comments(spark, sf).groupBy("idcampaign").agg(F.count("*").alias("comments"))
    return per.join(frames.campaigns(spark, sf), "idcampaign").join(
        frames.advertisers(spark, sf), "idadvertiser"
    ).select("idcampaign", "idadvertiser", "advertiser_name", "comments")


CHANGES_SQL = f"""changes as (
  select distinct o_custkey as first_aid, year(o_orderdate) as y, month(o_orderdate) as m,
    {frames.TYPES_SQL}[cast(substr(o_orderpriority, 1, 1) as int) + 1] as change_type from orders)"""


@query("J3_five_table_chain", "with " + SUMMARY_SQL + ", " + CHANGES_SQL + """
select s.idcampaign, s.csr_year, s.csr_month, c.c_name as advertiser_name, h.change_type, p.s_name as product, s.net_cost
from summary s join orders r on r.o_orderkey = s.idcampaign and r.o_orderstatus <> 'P'
join customer c on c.c_custkey = s.idadvertiser
join changes h on h.first_aid = s.idadvertiser_master and h.y = s.csr_year and h.m = s.csr_month
join supplier p on p.s_suppkey = s.idoffer""")
def j3(spark, sf):
    base = summary(spark, sf).join(frames.report(spark, sf), "idcampaign").join(
        frames.advertisers(spark, sf), "idadvertiser")
    changed = frames.changes(spark, sf).withColumnRenamed("first_aid", "idadvertiser_master")
    base = J.join_on_month(base, changed, ["idadvertiser_master"], "reporting_date")
    return base.join(frames.offers(spark, sf), "idoffer").select(
        "idcampaign", "csr_year", "csr_month", "advertiser_name", "change_type", "product", "net_cost")


@query("J4_join_on_derived_month", "with " + SUMMARY_SQL + ", " + CHANGES_SQL + """
select s.idcampaign, s.csr_year, s.csr_month, h.change_type from summary s
join changes h on h.first_aid = s.idadvertiser and h.y = s.csr_year and h.m = s.csr_month""")
def j4(spark, sf):
    changed = frames.changes(spark, sf).withColumnRenamed("first_aid", "idadvertiser")
    return J.join_on_month(summary(spark, sf), changed, ["idadvertiser"], "reporting_date").select(
        "idcampaign", "csr_year", "csr_month", "change_type")


@query("J5_left_join_on_month", "with " + SUMMARY_SQL + ", " + COMMENTS_SQL + """
select s.idcampaign, s.csr_year, s.csr_month, coalesce(c.n, 0) as comments from summary s
left join (select idcampaign, year(cc_entered) as y, month(cc_entered) as m, count(*) as n from comments group by all) c
  on c.idcampaign = s.idcampaign and c.y = s.csr_year and c.m = s.csr_month""")
def j5(spark, sf):
    per = frames.comments(spark, sf).groupBy(
        "idcampaign", F.year("cc_entered").alias("csr_year"), F.month("cc_entered").alias("csr_month")
    ).agg(F.count("*").alias("comments"))
    keys = ["idcampaign", "csr_year", "csr_month"]
    return J.left_join(summary(spark, sf), per, keys).select(*keys, F.coalesce("comments", F.lit(0)).alias("comments"))


EXCLUDED_SQL = "select distinct s_nationkey from supplier where s_acctbal < 0"


@query("J6_exclusion_join", "with " + SUMMARY_SQL + f"""
select idcampaign, csr_year, csr_month, idbusiness from summary where idbusiness not in ({EXCLUDED_SQL})""")
def j6(spark, sf):
    return J.drop_keys(summary(spark, sf), frames.excluded_businesses(spark, sf), "idbusiness").select(
        "idcampaign", "csr_year", "csr_month", "idbusiness")


@query("J7_exists_flag", "with " + SUMMARY_SQL + """
select s.idcampaign, s.csr_year, s.csr_month, cast(exists (select 1 from lineitem l where l.l_returnflag = 'R'
  and l.l_orderkey = s.idcampaign and year(l.l_shipdate) = s.csr_year and month(l.l_shipdate) = s.csr_month) as int)
  as advtrans from summary s""")
def j7(spark, sf):
    moved = frames.transfer_log(spark, sf).select(
        "idcampaign", F.year("created").alias("csr_year"), F.month("created").alias("csr_month"))
    keys = ["idcampaign", "csr_year", "csr_month"]
    return J.flag_exists(summary(spark, sf), moved, keys, "advtrans").select(*keys, "advtrans")


@query("J8_semi_join", """
select l_orderkey, l_linenumber from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal < 0)""")
def j8(spark, sf):
    listed = table(spark, sf, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("l_suppkey"))
    return J.keep_keys(table(spark, sf, "lineitem"), listed, "l_suppkey").select("l_orderkey", "l_linenumber")


@query("J9_anti_join", "with " + CYCLES_SQL + """
select cycle_id, master_id from cycles where master_id not in (select master_id from cycles where offer_name is null)""")
def j9(spark, sf):
    rows = cycles(spark, sf)
    return J.drop_keys(rows, rows.where(F.col("offer_name").isNull()).select("master_id").distinct(), "master_id").select(
        "cycle_id", "master_id")


@query("J13_per_key_lookup", """
select event_id, user_id, value - m as over_mean_cents from (select event_id, user_id,
  cast(floor(value * 100 + 0.5) as bigint) as value,
  cast(floor(sum(cast(floor(value * 100 + 0.5) as bigint)) over (partition by user_id)
    / cast(count(*) over (partition by user_id) as double)) as bigint) as m from events)""")
def j13(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.floor(F.col("value") * 100 + 0.5).alias("v"))
    per = aggregate_apart(rows, ["user_id"], F.floor(F.sum("v") / F.count("*").cast("double")).alias("m"))
    return rows.join(per, "user_id").select("event_id", "user_id", (F.col("v") - F.col("m")).alias("over_mean_cents"))


@query("J14_columns_side_by_side", """
select o_orderkey, cast(month(o_orderdate) as bigint) as start_month, cast(o_orderstatus = 'F' as int) as status_f,
  cast(o_orderstatus = 'O' as int) as status_o from orders""")
def j14(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus").withColumns({
        "start_month": F.month("o_orderdate").cast("long"),
        "status_f": (F.col("o_orderstatus") == "F").cast("int"),
        "status_o": (F.col("o_orderstatus") == "O").cast("int"),
    }).drop("o_orderdate", "o_orderstatus")


@query("J15_key_coverage", """
select (select count(distinct o_orderkey) from orders) as keys_a,
  (select count(distinct l_orderkey) from lineitem where l_returnflag = 'R') as keys_b,
  (select count(distinct o_orderkey) from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')) as shared,
  (select count(distinct o_orderkey) from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')) as only_a,
  (select count(distinct l_orderkey) from lineitem where l_returnflag = 'R' and l_orderkey not in (select o_orderkey from orders)) as only_b""")
def j15(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("k"))
    return J.coverage(a, b, "k")


@query("U1_union_all", """
select type, count(*) as n from (select 'zero' as type from orders where o_totalprice < 20000
  union all select 'increase' from orders where o_totalprice > 200000 union all select 'decrease' from orders where o_totalprice < 30000)
group by 1""")
def u1(spark, sf):
    rows = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    flags = [rows.where(cond).select(F.lit(name).alias("type")) for name, cond in (
        ("zero", price < 20000), ("increase", price > 200000), ("decrease", price < 30000))]
    return flags[0].unionByName(flags[1]).unionByName(flags[2]).groupBy("type").agg(F.count("*").alias("n"))


@query("U2_union_distinct", """
select o_custkey as k from orders where o_orderstatus = 'F' union select c_custkey from customer where c_acctbal < 0""")
def u2(spark, sf):
    a = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("k"))
    return a.union(b).distinct().orderBy("k")


@query("U4_key_difference", """
select c_custkey as k from customer except select o_custkey from orders where o_totalprice > 150000""")
def u4(spark, sf):
    some = table(spark, sf, "orders").where(F.col("o_totalprice") > 150000).select(F.col("o_custkey").alias("k"))
    return J.drop_keys(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), some.distinct(), "k")
