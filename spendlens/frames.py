"""The domain's tables expressed over the given parquet tables.

Every adapter is a lazy DataFrame; the SQL twins at the end are the same tables for the
checks in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import bucket_index
from .functions.numbers import exact_sum
from .operators.buckets import densify
from .plans.churn import CHANGE_TYPES

# fixed values: calendar of the given tables
FIRST_QUARTER, LAST_QUARTER = 1995 * 4, 2001 * 4 + 2
FIRST_MONTH, LAST_MONTH = 1995 * 12, 2001 * 12 + 7
LAST_SHIP_MONTH = 2001 * 12 + 10
CUTOFF = "1996-12-31"
FIRST_YEAR = 1996


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def priority_digit():
    return F.substring("o_orderpriority", 1, 1).cast("int")


def campaign_master():
    return F.col("o_custkey") * 10 + priority_digit()


def customers(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop(
        "n_nationkey"
    )


def cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Billing cycles: an order runs from its date to its first shipment.

    Orders without lines have no end; some offers and starts are missing, some budgets are
    zero; most reported ends lie before the start.
    """
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min(F.col("l_shipdate").cast("date")).alias("ended"),
        (F.sum(F.col("l_quantity").cast("long")) % 60).cast("int").alias("_days"),
    )
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = orders.join(customers(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    no_offer = (priority_digit() == 4) & (F.dayofmonth(day) == 31)
    no_start = (F.col("o_orderstatus") == "P") & (F.month(day) == 6) & (F.dayofmonth(day) == 30)
    return orders.select(
        F.col("o_orderkey").alias("cycle_id"),
        F.col("o_custkey").alias("master_id"),
        F.col("o_custkey").alias("idadvertiser"),
        campaign_master().alias("idcampaign_master"),
        F.col("o_orderkey").alias("idcampaign"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("category"),
        "state",
        F.when(~no_offer, F.col("o_orderpriority")).alias("offer_name"),
        F.when(F.dayofmonth(day) == 15, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("budget"),
        F.when(~no_start, day).alias("started"),
        "ended",
        F.date_add(day, F.col("_days")).alias("short_end"),
    )


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly cost and counters per campaign."""
    ship = F.col("l_shipdate")
    monthly = table(spark, sf, "lineitem").groupBy(
        F.year(ship).alias("csr_year"), F.month(ship).alias("csr_month"), F.col("l_orderkey").alias("idcampaign")
    ).agg(
        exact_sum(F.col("l_extendedprice")).alias("net_cost"),
        (F.sum(F.col("l_quantity").cast("long")) * F.lit(-1000.0)).alias("net_cost_adjustment"),
        F.min("l_suppkey").alias("idoffer"),
        F.count("*").alias("clicks"),
        F.sum(F.col("l_quantity").cast("long")).alias("impressions"),
        F.count_if(F.col("l_returnflag") == "R").alias("calls"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)).alias("qualified_calls"),
        F.count_if(F.col("l_linestatus") == "O").alias("emails"),
        F.count_if(F.col("l_quantity") < 10).alias("cvt"),
        F.count_if((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40)).alias("qualified_web_events"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("idcampaign"), campaign_master().alias("idcampaign_master"),
        F.col("o_custkey").alias("idadvertiser"), F.col("o_totalprice").alias("campaign_budget"),
        priority_digit().alias("_digit"),
    )
    owners = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("idadvertiser"), F.col("c_nationkey").cast("long").alias("idbusiness")
    )
    return (
        monthly.join(orders, "idcampaign").join(owners, "idadvertiser")
        .withColumn("idadvertiser_master", F.col("idadvertiser"))
    )


def advertisers(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select(
        F.col("c_custkey").alias("idadvertiser"), F.col("c_name").alias("advertiser_name"),
        F.concat(F.lit("City "), F.col("c_custkey") % 50).alias("advertiser_city"),
        F.col("state").alias("advertiser_state"), F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("advertiser_zipcode"),
        F.length("c_mktsegment").cast("long").alias("idbusinesscategory"),
        F.col("c_mktsegment").alias("business_category"),
        F.col("c_nationkey").cast("long").alias("idbusinesssubcategory"),
        F.concat("c_mktsegment", F.lit(" in "), "state").alias("business_subcategory"),
    )


def advertiser_masters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("idadvertiser"), F.col("c_custkey").alias("idadvertiser_master")
    )


def excluded_businesses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").where(F.col("s_acctbal") < 0).select(
        F.col("s_nationkey").cast("long").alias("idbusiness")
    ).distinct()


def comments(spark: SparkSession, sf: str) -> DataFrame:
    stop = F.concat(F.lit("*USER STOP REQUEST* "), F.col("props"))
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("event_id") % 2480).cast("int"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("idcampaign"),
        F.when(F.col("event_type") == "error", 1).otherwise(2).alias("user_id"),
        F.when(F.col("event_type") == "signup", stop).otherwise(F.col("props")).alias("cc_comment"),
        day.cast("timestamp").alias("cc_entered"),
    )


def campaigns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("idcampaign"), campaign_master().alias("idcampaign_master"),
        F.col("o_custkey").alias("idadvertiser"), F.concat(F.lit("C"), "o_orderkey").alias("campaign_name"),
        (F.col("o_custkey") % 100).alias("idoffer"),
    )


def report(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("idcampaign")
    )


def changes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.array(*[F.lit(c) for c in CHANGE_TYPES])[priority_digit()]
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("first_aid"), F.trunc("o_orderdate", "month").alias("reporting_date"),
        kind.alias("change_type"),
    ).distinct()


def offers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("idoffer"), F.col("s_name").alias("product")
    )


def transfer_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("idcampaign"), F.col("l_shipdate").alias("created")
    )


def mart_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Campaign-month rows in the shape of the mart, with seven change types."""
    base = summary(spark, sf).join(advertisers(spark, sf), "idadvertiser")
    kind = F.array(*[F.lit(c) for c in CHANGE_TYPES])[(F.col("_digit") + F.col("csr_month")) % 7]
    return base.select(
        "csr_year", "csr_month", "idcampaign_master", "idcampaign", "idadvertiser", "advertiser_name",
        "advertiser_state", "business_category", "idoffer", "campaign_budget",
        F.col("net_cost").alias("spend"), "clicks", "impressions", "calls", kind.alias("adv_change_type"),
        F.when(F.col("clicks") > 1, F.col("calls").cast("int")).alias("stop_request"),
    )


def supplier_series(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly revenue per supplier, zero-filled: (key, t, x)."""
    booked = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("key"), bucket_index(F.col("l_shipdate"), "month").alias("bucket_idx")
    ).agg(exact_sum(F.col("l_extendedprice")).alias("value"))
    return _as_series(booked, FIRST_MONTH, LAST_SHIP_MONTH)


def customer_series(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly order value per customer, mostly zero: (key, t, x)."""
    booked = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("key"), bucket_index(F.col("o_orderdate"), "month").alias("bucket_idx")
    ).agg(exact_sum(F.col("o_totalprice")).alias("value"))
    return _as_series(booked, FIRST_MONTH, LAST_MONTH)


def segment_series(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly order value per segment and nation: short, full series."""
    booked = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).groupBy(
        F.col("c_nationkey").cast("long").alias("key"), bucket_index(F.col("o_orderdate"), "quarter").alias("bucket_idx")
    ).agg(exact_sum(F.col("o_totalprice")).alias("value"))
    return _as_series(booked, FIRST_QUARTER, LAST_QUARTER)


def _as_series(booked: DataFrame, first: int, last: int) -> DataFrame:
    return densify(booked, "key", first, last).select(
        "key", (F.col("bucket_idx") - first).cast("long").alias("t"), F.col("value").alias("x")
    )


# --- SQL twins ------------------------------------------------------------------------------

MONEY = "cast(sum(cast({0} as decimal(18,2))) as double)"

CYCLES_SQL = """cycles as (
  select o.o_orderkey as cycle_id, o.o_custkey as master_id, o.o_custkey as idadvertiser,
    o.o_custkey * 10 + cast(substr(o.o_orderpriority, 1, 1) as int) as idcampaign_master,
    o.o_orderkey as idcampaign,
    case when c.c_acctbal >= 0 then c.c_mktsegment end as category, n.n_name as state,
    case when substr(o.o_orderpriority, 1, 1) = '4' and day(o.o_orderdate) = 31 then null
         else o.o_orderpriority end as offer_name,
    case when day(o.o_orderdate) = 15 then 0.0 else o.o_totalprice end as budget,
    case when o.o_orderstatus = 'P' and month(o.o_orderdate) = 6 and day(o.o_orderdate) = 30 then null
         else cast(o.o_orderdate as date) end as started,
    l.ended, cast(o.o_orderdate as date) + l.days as short_end
  from orders o
  left join (select l_orderkey, cast(min(l_shipdate) as date) as ended,
                    cast(sum(cast(l_quantity as bigint)) % 60 as int) as days
             from lineitem group by l_orderkey) l on o.o_orderkey = l.l_orderkey
  join customer c on o.o_custkey = c.c_custkey
  join nation n on c.c_nationkey = n.n_nationkey)"""

SUMMARY_SQL = f"""summary as (
  select m.*, o.o_custkey * 10 + cast(substr(o.o_orderpriority, 1, 1) as int) as idcampaign_master,
    o.o_custkey as idadvertiser, o.o_custkey as idadvertiser_master, o.o_totalprice as campaign_budget,
    cast(substr(o.o_orderpriority, 1, 1) as int) as digit, cast(c.c_nationkey as bigint) as idbusiness
  from (select cast(year(l_shipdate) as int) as csr_year, cast(month(l_shipdate) as int) as csr_month, l_orderkey as idcampaign,
          {MONEY.format('l_extendedprice')} as net_cost,
          sum(cast(l_quantity as bigint)) * -1000.0 as net_cost_adjustment,
          min(l_suppkey) as idoffer, count(*) as clicks,
          cast(sum(cast(l_quantity as bigint)) as bigint) as impressions,
          count(*) filter (l_returnflag = 'R') as calls,
          count(*) filter (l_returnflag = 'R' and l_quantity > 25) as qualified_calls,
          count(*) filter (l_linestatus = 'O') as emails, count(*) filter (l_quantity < 10) as cvt,
          count(*) filter (l_linestatus = 'O' and l_quantity > 40) as qualified_web_events
        from lineitem group by all) m
  join orders o on o.o_orderkey = m.idcampaign join customer c on c.c_custkey = o.o_custkey)"""

TYPES_SQL = "['Change down', 'Change up', 'Churn', 'Idle down', 'Idle up', 'New', 'No change']"

MART_SQL = SUMMARY_SQL + f""",
mart as (
  select s.csr_year, s.csr_month, s.idcampaign_master, s.idcampaign, s.idadvertiser,
    c.c_name as advertiser_name, n.n_name as advertiser_state, c.c_mktsegment as business_category,
    s.idoffer, s.campaign_budget, s.net_cost as spend, s.clicks, s.impressions, s.calls,
    {TYPES_SQL}[((s.digit + s.csr_month) % 7) + 1] as adv_change_type,
    case when s.clicks > 1 then s.calls end as stop_request
  from summary s join customer c on c.c_custkey = s.idadvertiser
  join nation n on n.n_nationkey = c.c_nationkey)"""


def series_sql(name: str, key: str, source: str, date: str, value: str, grain: str, first: int, last: int) -> str:
    """CTE (key, t, x) with a row for every bucket."""
    index = {
        "month": f"year({date}) * 12 + month({date}) - 1",
        "quarter": f"year({date}) * 4 + quarter({date}) - 1",
    }[grain]
    return f"""{name}_sums as (
  select cast({key} as bigint) as key, {index} as b, {MONEY.format(value)} as v
  from {source} group by all),
{name} as (
  select k.key, cast(g.b - {first} as bigint) as t, coalesce(s.v, 0.0) as x
  from (select distinct key from {name}_sums) k cross join (select unnest(range({first}, {last + 1})) as b) g
  left join {name}_sums s on s.key = k.key and s.b = g.b)"""


SUPPLIER_SQL = series_sql("series", "l_suppkey", "lineitem", "l_shipdate", "l_extendedprice", "month",
                          FIRST_MONTH, LAST_SHIP_MONTH)
CUSTOMER_SQL = series_sql("series", "o_custkey", "orders", "o_orderdate", "o_totalprice", "month",
                          FIRST_MONTH, LAST_MONTH)
SEGMENT_SQL = series_sql("series", "c_nationkey", "orders join customer on o_custkey = c_custkey", "o_orderdate",
                         "o_totalprice", "quarter", FIRST_QUARTER, LAST_QUARTER)
