"""Projections, filters and imputation."""

from pyspark.sql import functions as F

from ..frames import CUTOFF, CYCLES_SQL, MART_SQL, CHANGE_TYPES, cycles, mart_rows, summary, table
from ..functions import clamp0, parse_date, recode, strip_suffix_names, unless, year_month
from ..operators import clean
from ..plans.mart import STOP_PATTERN
from . import query

C = "with " + CYCLES_SQL + " "
TEXT_DATES = """cast(started as varchar) as started, cast(ended as varchar) as ended"""


def _text(df, *cols):
    """Dates as text, so that both engines return the same kind of value."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


@query("P1_column_subset", C + "select cycle_id, category, budget from cycles")
def p1(spark, sf):
    return cycles(spark, sf).select("cycle_id", "category", "budget")


@query("P2_column_drop", "select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem")
def p2(spark, sf):
    return table(spark, sf, "lineitem").drop(
        "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
    )


@query("P3_rename_by_map", """
select o_orderkey as idcampaign, o_custkey as idadvertiser, o_totalprice as campaign_budget from orders""")
def p3(spark, sf):
    names = {"o_orderkey": "idcampaign", "o_custkey": "idadvertiser", "o_totalprice": "campaign_budget"}
    return table(spark, sf, "orders").select(*names).withColumnsRenamed(names)


@query("P4_strip_name_suffix", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def p4(spark, sf):
    supplier = table(spark, sf, "supplier")
    return strip_suffix_names(supplier.toDF(*[f"{c}_varchar" for c in supplier.columns]), "_varchar")


@query("P5_computed_column", """
select o_orderkey, cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as time_stamp, 0 as zero_flag from orders""")
def p5(spark, sf):
    stamp = year_month(F.year("o_orderdate"), F.month("o_orderdate")).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", stamp.alias("time_stamp"), F.lit(0).alias("zero_flag"))


@query("P6_comparison_filter", C + "select cycle_id, budget from cycles where budget >= 1 and started >= date '1996-01-01'")
def p6(spark, sf):
    return cycles(spark, sf).where(
        unless(F.col("budget") < 1) & (F.col("started") >= F.lit("1996-01-01").cast("date"))
    ).select("cycle_id", "budget")


@query("P7_compound_predicate", "with " + MART_SQL + """
select idcampaign, csr_year, csr_month, spend from mart
where ((adv_change_type = 'Idle down') or (adv_change_type = 'Idle up'))
  and coalesce(not (campaign_budget = 0), true) and coalesce(not (stop_request = 0), true)""")
def p7(spark, sf):
    kind = F.col("adv_change_type")
    return mart_rows(spark, sf).where(
        ((kind == "Idle down") | (kind == "Idle up"))
        & unless(F.col("campaign_budget") == 0) & unless(F.col("stop_request") == 0)
    ).select("idcampaign", "csr_year", "csr_month", "spend")


@query("P8_null_filter", C + "select cycle_id, master_id from cycles where ended is null and started is not null")
def p8(spark, sf):
    return cycles(spark, sf).where(F.col("ended").isNull() & F.col("started").isNotNull()).select("cycle_id", "master_id")


@query("P9_drop_missing", C + "select cycle_id, category from cycles where category is not null and ended is not null")
def p9(spark, sf):
    return cycles(spark, sf).dropna(subset=["category", "ended"]).select("cycle_id", "category")


@query("P10_fill_literal", C + """
select cycle_id, coalesce(category, 'Other') as category, coalesce(offer_name, 'none') as offer_name from cycles""")
def p10(spark, sf):
    return clean.fill(cycles(spark, sf), {"category": "Other", "offer_name": "none"}).select(
        "cycle_id", "category", "offer_name")


DURATION = "date_diff('day', least(started, ended), greatest(started, ended))"
DURATIONS = C + f""", sized as (select *, case when started is not null and ended is not null then {DURATION} end as duration
  from cycles), usual as (select duration from sized where duration is not null group by 1
  order by count(*) desc, duration limit 1) """


@query("P11_fill_mode", DURATIONS + """
select cycle_id, cast(coalesce(duration, (select duration from usual)) as bigint) as duration from sized""")
def p11(spark, sf):
    sized = clean.with_duration(clean.order_dates(cycles(spark, sf)))
    return clean.fill_mode(sized, "duration").select("cycle_id", "duration")


@query("P12_fill_end_date", DURATIONS + """
select cycle_id, cast(case when ended is null then started + cast((select duration from usual) as int)
  when started is null then ended else greatest(started, ended) end as varchar) as ended from sized""")
def p12(spark, sf):
    sized = clean.with_duration(clean.order_dates(cycles(spark, sf)))
    return _text(clean.fill_end_date(sized).select("cycle_id", "ended"), "ended")


@query("P13_fill_group_mean", DURATIONS + """
select cycle_id, cast(case when duration is null and started >= date '1998-01-01'
  then m.mean else duration end as double) as duration
from sized left join (select master_id, sum(duration) / count(duration)::double as mean from sized group by 1) m
  using (master_id)""")
def p13(spark, sf):
    sized = clean.with_duration(clean.order_dates(cycles(spark, sf))).withColumn(
        "duration", F.col("duration").cast("double"))
    late = F.col("started") >= F.lit("1998-01-01").cast("date")
    return clean.fill_group_mean(sized, "master_id", "duration", late).select("cycle_id", "duration")


@query("P14_swap_reversed_dates", C + """
select cycle_id, cast(case when ended < started then ended else started end as varchar) as started,
  cast(case when ended < started then started else ended end as varchar) as ended from cycles""")
def p14(spark, sf):
    return _text(clean.order_dates(cycles(spark, sf)).select("cycle_id", "started", "ended"), "started", "ended")


@query("P15_drop_cutoff_date", C + f"""
select cycle_id, {TEXT_DATES} from cycles where started <> date '{CUTOFF}' or started is null""")
def p15(spark, sf):
    return _text(clean.drop_on_date(cycles(spark, sf), "started", CUTOFF).select(
        "cycle_id", "started", "ended"), "started", "ended")


@query("P16_date_parse", """
select o_orderkey, case when day(o_orderdate) <> 13 then cast(cast(o_orderdate as date) as varchar) end as parsed
from orders""")
def p16(spark, sf):
    text = F.when(F.dayofmonth("o_orderdate") == 13, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", parse_date(text).cast("string").alias("parsed"))


@query("P17_promote_numeric", """
select cast(o_orderkey as double) as o_orderkey, cast(o_custkey as double) as o_custkey, o_orderstatus,
  case when o_custkey = 7 then 'n/a' else cast(o_orderkey as varchar) end as mixed from orders""")
def p17(spark, sf):
    text = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus",
        F.when(F.col("o_custkey") == 7, "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("mixed"),
    )
    return clean.promote_numeric(text)


@query("P18_to_numeric", """
select event_id, try_cast(regexp_replace(props, '[^0-9]', '', 'g') as double) as k from events""")
def p18(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.regexp_replace("props", "[^0-9]", "").try_cast("double").alias("k"))


@query("P19_masked_replacement", """
select o_orderkey, case when o_orderstatus = 'P' and o_totalprice < 50000 then 'offline' else o_orderstatus end
  as o_orderstatus from orders""")
def p19(spark, sf):
    mask = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 50000)
    return clean.replace_where(table(spark, sf, "orders"), "o_orderstatus", mask, F.lit("offline")).select(
        "o_orderkey", "o_orderstatus")


RECODES = {"1-URGENT": "Churn", "2-HIGH": "Change up", "3-MEDIUM": "No change", "5-LOW": "New"}


@query("P20_dictionary_recode", """
select o_orderkey, case o_orderpriority when '1-URGENT' then 'Churn' when '2-HIGH' then 'Change up'
  when '3-MEDIUM' then 'No change' when '5-LOW' then 'New' else o_orderpriority end as change_type from orders""")
def p20(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", recode(F.col("o_orderpriority"), RECODES).alias("change_type"))


@query("P21_between_timestamps", """
select event_id from events where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 00:00:00'""")
def p21(spark, sf):
    lo, hi = (F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-20"))
    return table(spark, sf, "events").where(F.col("ts").between(lo, hi)).select("event_id")


@query("P22_like_literal_asterisks", """
select event_id from events where event_type = 'signup'""")
def p22(spark, sf):
    note = F.when(F.col("event_type") == "signup", F.concat(F.lit("*USER STOP REQUEST* "), "props")).otherwise(
        F.concat(F.lit("USER STOP REQUEST "), "props"))
    return table(spark, sf, "events").where(note.like(STOP_PATTERN)).select("event_id")


@query("P23_clamp_negative", "with " + MART_SQL + """
select idcampaign, csr_year, csr_month, case when net_cost + net_cost_adjustment < 0 then 0
  else net_cost + net_cost_adjustment end as spend from summary""")
def p23(spark, sf):
    return summary(spark, sf).select(
        "idcampaign", "csr_year", "csr_month", clamp0(F.col("net_cost") + F.col("net_cost_adjustment")).alias("spend"))


@query("P24_distinct", "with " + MART_SQL + " select distinct idadvertiser, adv_change_type from mart")
def p24(spark, sf):
    return mart_rows(spark, sf).select("idadvertiser", "adv_change_type").distinct()


@query("P25_co_missing", C + """
select count(*) filter (ended is null) as missing_a, count(*) filter (short_end is null) as missing_b,
  count(*) filter (ended is null and short_end is null) as missing_both,
  cast(count(*) filter (ended is null and short_end is null) = count(*) filter (ended is null) as bigint) as together
from cycles""")
def p25(spark, sf):
    return clean.co_missing(cycles(spark, sf), "ended", "short_end")


@query("P26_equal_share", """
select count(*) as n_rows, count(*) filter (month(o_orderdate) = month(first_ship)) as n_equal,
  cast(count(*) filter (month(o_orderdate) = month(first_ship)) = count(*) as bigint) as all_equal
from orders left join (select l_orderkey, min(l_shipdate) as first_ship from lineitem group by 1)
  on l_orderkey = o_orderkey""")
def p26(spark, sf):
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.month(F.min("l_shipdate")).alias("ship_month"))
    months = table(spark, sf, "orders").select("o_orderkey", F.month("o_orderdate").alias("order_month")).join(
        first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return clean.equal_share(months, "order_month", "ship_month")


@query("P27_sample_keys", """
select o_custkey, o_orderkey, o_totalprice from orders where o_custkey in (
  select k from (select distinct o_custkey as k from orders) order by md5(cast(k as varchar) || ':7'), k limit 10)""")
def p27(spark, sf):
    return clean.sample_keys(table(spark, sf, "orders"), "o_custkey", 10, seed=7).select(
        "o_custkey", "o_orderkey", "o_totalprice")


@query("P27_sample_rows", """
select o_orderkey, o_custkey, o_totalprice from orders
where cast('0x' || substr(md5(cast(o_orderkey as varchar) || ':7'), 1, 8) as bigint) < 0.001 * 4294967296""")
def p27_rows(spark, sf):
    return clean.sample_rows(table(spark, sf, "orders"), "o_orderkey", 0.001, seed=7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("P28_one_key", """
select o_orderkey, o_totalprice from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING'""")
def p28(spark, sf):
    one = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return table(spark, sf, "orders").join(one, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(
        "o_orderkey", "o_totalprice")


@query("F17_category_code", "with " + MART_SQL + """
select idcampaign, csr_year, csr_month,
  list_position(['Change down', 'Change up', 'Churn', 'Idle down', 'Idle up', 'New', 'No change'], adv_change_type) - 1
  as type_encoded from mart""")
def f17(spark, sf):
    codes = {name: i for i, name in enumerate(sorted(CHANGE_TYPES))}
    return mart_rows(spark, sf).select(
        "idcampaign", "csr_year", "csr_month",
        recode(F.col("adv_change_type"), codes, default=F.lit(-1)).alias("type_encoded"))


@query("F1_F18_scalar_functions", """
select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(month(o_orderdate) as bigint) as m,
  date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as days,
  cast(cast(o_orderdate as date) + 30 as varchar) as due,
  (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 as months,
  cast(ceil(o_totalprice / 7) as bigint) as up, abs(o_totalprice - 100000) as off,
  o_custkey // 10 as whole, o_custkey % 10 as rest, o_custkey // 10 + (o_custkey % 10 > 0)::int as parts,
  round(sin(2 * pi() * o_custkey / 30.0), 6) as wave, round(cos(2 * pi() * o_custkey / 30.0), 6) as cowave,
  replace(substr(o_orderpriority, 3), ' ', '_') as word, split_part(o_orderpriority, '-', 1) as digit,
  year(o_orderdate) || '-Q' || quarter(o_orderdate) as quarter_label,
  year(o_orderdate) || '-M' || month(o_orderdate) as month_label,
  cast(o_orderdate = timestamp '1996-12-31' as int) as is_cutoff
from orders""")
def f_all(spark, sf):
    from ..functions import bucket_index, bucket_label, day_gap, month_gap
    date, base = F.col("o_orderdate"), F.lit("1995-01-01").cast("date")
    turn = 2 * F.pi() * F.col("o_custkey") / 30.0
    return table(spark, sf, "orders").select(
        "o_orderkey", F.year(date).cast("long").alias("y"), F.month(date).cast("long").alias("m"),
        day_gap(date, base).alias("days"),
        F.date_add(date.cast("date"), 30).cast("string").alias("due"),
        month_gap(date, base).cast("long").alias("months"),
        F.ceil(F.col("o_totalprice") / 7).alias("up"), F.abs(F.col("o_totalprice") - 100000).alias("off"),
        F.floor(F.col("o_custkey") / 10).alias("whole"), (F.col("o_custkey") % 10).alias("rest"),
        F.ceil(F.col("o_custkey") / 10).alias("parts"),
        F.round(F.sin(turn), 6).alias("wave"), F.round(F.cos(turn), 6).alias("cowave"),
        F.regexp_replace(F.substring("o_orderpriority", 3, 20), " ", "_").alias("word"),
        F.split("o_orderpriority", "-")[0].alias("digit"),
        bucket_label(bucket_index(date, "quarter"), "quarter").alias("quarter_label"),
        bucket_label(bucket_index(date, "month"), "month").alias("month_label"),
        (date.cast("date") == F.lit(CUTOFF).cast("date")).cast("int").alias("is_cutoff"),
    )
