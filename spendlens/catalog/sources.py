"""Sources, sinks and table management."""

from pyspark.sql import functions as F

from .. import schemas
from ..frames import CYCLES_SQL, SUMMARY_SQL, comments, cycles, summary, table
from ..operators.aggregates import duplicate_keys
from ..operators.clean import drop_marker_rows
from ..operators.joins import drop_keys
from ..session import scratch_path
from ..sources import (
    append_to, head_rows, materialize, read_cycles, read_delimited, row_range, schema_table, typed_empty,
    write_csv, write_lines,
)
from . import query

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORDERS_SQL = f"select {', '.join(ORDER_COLS)} from orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*ORDER_COLS)


@query("S1_csv_scan", """
select cycle_id as idcampaign, master_id as idadvertiser_master, category as BusinessCategory,
  budget as campaign_budget, cast(started as varchar) as Cycle_Started, cast(ended as varchar) as Cycle_Ended
from (with """ + CYCLES_SQL + """ select * from cycles)""")
def s1(spark, sf):
    source = cycles(spark, sf).select(
        F.col("master_id").alias("idadvertiser_master"), F.col("cycle_id").alias("idcampaign"),
        F.col("category").alias("BusinessCategory"), F.col("budget").alias("campaign_budget"),
        F.col("started").cast("string").alias("Cycle_Started"), F.col("ended").cast("string").alias("Cycle_Ended"),
    )
    # the files have a row label in front, another order, and columns outside the schema
    shuffled = source.select(
        F.lit(0).alias("Unnamed: 0"), "Cycle_Ended", "campaign_budget", "idcampaign", F.lit("x").alias("region"),
        "BusinessCategory", "Cycle_Started", "idadvertiser_master",
    )
    path = scratch_path(spark, "cycles-csv")
    write_csv(shuffled, path)
    return read_cycles(spark, path).select(*source.columns)


def _export(spark, sf):
    """Headerless export with the null marker, and its side file of names."""
    mark = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "\\N").otherwise(F.col("o_orderpriority"))
    rows = _orders(spark, sf).withColumn("o_orderpriority", mark)
    path, names = scratch_path(spark, "export"), scratch_path(spark, "names")
    rows.write.option("sep", "\u0001").csv(path)
    header = ",".join(f"{c}_varchar" for c in ORDER_COLS)
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(names)
    return read_delimited(spark, path, names)


@query("S2_delimited_scan", """
select cast(o_orderkey as varchar) as o_orderkey_varchar, cast(o_custkey as varchar) as o_custkey_varchar,
  o_orderstatus as o_orderstatus_varchar,
  case when o_orderpriority = '4-NOT SPECIFIED' then '\\N' else o_orderpriority end as o_orderpriority_varchar
from orders""")
def s2(spark, sf):
    return _export(spark, sf).drop("o_totalprice_varchar")


@query("S3_drop_marker_rows", """
select cast(o_orderkey as varchar) as o_orderkey_varchar, o_orderpriority as o_orderpriority_varchar
from orders where o_orderpriority <> '4-NOT SPECIFIED'""")
def s3(spark, sf):
    return drop_marker_rows(_export(spark, sf)).select("o_orderkey_varchar", "o_orderpriority_varchar")


@query("S4_head_scan", ORDERS_SQL + " order by o_totalprice desc, o_orderkey limit 100")
def s4(spark, sf):
    return head_rows(_orders(spark, sf), 100, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("S5_row_range", ORDERS_SQL + " order by o_custkey, o_orderkey limit 500 offset 300")
def s5(spark, sf):
    return row_range(_orders(spark, sf), 300, 500, ["o_custkey", "o_orderkey"])


@query("S6_table_scan", ORDERS_SQL)
def s6(spark, sf):
    _orders(spark, sf).createOrReplaceTempView("spendlens_orders")
    return spark.table("spendlens_orders")


@query("S7_csv_sink", ORDERS_SQL)
def s7(spark, sf):
    path = scratch_path(spark, "sink-csv")
    rows = _orders(spark, sf)
    write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("S8_line_sink", """
select cast(f as varchar) as value, count(*) as n from (
  select case when o_totalprice > 100000 then 1 else 0 end as f from orders
  union all select case when o_orderstatus = 'F' then 1 else 0 end from orders) group by 1""")
def s8(spark, sf):
    path = scratch_path(spark, "lines")
    rows = table(spark, sf, "orders")
    write_lines(rows, F.when(F.col("o_totalprice") > 100000, 1).otherwise(0), path)
    write_lines(rows, F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), path, mode="append")
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@query("S9_create_table_as", "with " + SUMMARY_SQL + """
select distinct idcampaign_master from summary where csr_year >= 1996 and net_cost > 0""")
def s9(spark, sf):
    rows = summary(spark, sf).where((F.col("csr_year") >= 1996) & (F.col("net_cost") > 0))
    return materialize(rows.select("idcampaign_master").distinct(), scratch_path(spark, "masters"))


@query("S10_typed_empty_table", """
select year(d) as cc_year, month(d) as cc_month, user_id as cid,
  count(*) as businessuser
from (select user_id, date '1995-01-01' + cast(event_id % 2480 as int) as d from events) group by all""")
def s10(spark, sf):
    rows = comments(spark, sf).groupBy(
        F.year("cc_entered").alias("cc_year"), F.month("cc_entered").alias("cc_month"),
        F.col("idcampaign").alias("cid"),
    ).agg(F.count("*").cast("int").alias("businessuser"))
    filled = typed_empty(spark, schemas.COMMENT_SUMMARY).unionByName(rows, allowMissingColumns=True)
    return filled.select(*[F.col(c).cast("long").alias(c) for c in ("cc_year", "cc_month", "cid", "businessuser")])


@query("S11_insert_select", """
select user_id as cid, count(*) as businessuser from events group by 1
union all select user_id as cid, count(*) from events where event_type = 'error' group by 1""")
def s11(spark, sf):
    path = scratch_path(spark, "appended")
    wanted = typed_empty(spark, schemas.COMMENT_SUMMARY).select("cid", "businessuser").schema
    events = table(spark, sf, "events")
    for part in (events, events.where(F.col("event_type") == "error")):
        append_to(part.groupBy(F.col("user_id").alias("cid")).agg(F.count("*").alias("businessuser")), path, wanted)
    return spark.read.schema(wanted).parquet(path).select("cid", F.col("businessuser").cast("long"))


@query("S12_replace_table", "select event_type, count(*) as n from events group by 1")
def s12(spark, sf):
    path = scratch_path(spark, "replaced")
    events = table(spark, sf, "events")
    materialize(events.groupBy("user_id").agg(F.count("*").alias("n")), path)
    return materialize(events.groupBy("event_type").agg(F.count("*").alias("n")), path)


@query("S13_add_nullable_column", """
select o_orderkey, cast(null as varchar) as advtrans from orders""")
def s13(spark, sf):
    # written as text for the comparison; the column itself is a nullable integer
    return table(spark, sf, "orders").select("o_orderkey").withColumn(
        "advtrans", F.lit(None).cast("int")).withColumn("advtrans", F.col("advtrans").cast("string"))


@query("S14_unique_key_violations", """
select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1""")
def s14(spark, sf):
    return duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("S15_schema_listing")
def s15(spark, sf):
    return schema_table(cycles(spark, sf))


@query("S16_delete_by_key", """
select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem
  where l_returnflag = 'R')""")
def s16(spark, sf):
    gone = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return drop_keys(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone.distinct(), "o_orderkey")
