"""Window operators."""

from pyspark.sql import functions as F

from ..frames import (
    CUSTOMER_SQL, CYCLES_SQL, SEGMENT_SQL, SUPPLIER_SQL, customer_series, cycles, segment_series, supplier_series, table,
)
from ..operators import windows as W
from ..operators.positions import keyed_positions
from . import query

SUP, CUS, SEG = (f"with {sql} " for sql in (SUPPLIER_SQL, CUSTOMER_SQL, SEGMENT_SQL))
BY_T = "partition by key order by t"

GAPS_SQL = "with " + CYCLES_SQL + """,
ordered as (select cycle_id, master_id, started, short_end,
    lag(short_end) over (partition by master_id order by started, short_end, cycle_id) as prev_end
  from cycles where started is not null and short_end is not null) """


@query("W1_cycle_gaps", GAPS_SQL + """
select cycle_id, coalesce(date_diff('day', prev_end, started), 0) as gap from ordered""")
def w1(spark, sf):
    return W.cycle_gaps(cycles(spark, sf), "master_id", "started", "short_end").select("cycle_id", "gap")


@query("W2_running_sum", GAPS_SQL + """
select cycle_id, cast(sum(date_diff('day', started, short_end) + coalesce(date_diff('day', prev_end, started), 0))
  over (partition by master_id order by started, short_end, cycle_id rows unbounded preceding) as bigint) as running from ordered""")
def w2(spark, sf):
    return W.cycle_gaps(cycles(spark, sf), "master_id", "started", "short_end").select("cycle_id", "running")


@query("W2_running_sum_series", SUP + f"""
select key, t, round(sum(x) over ({BY_T} rows unbounded preceding), 2) as running from series""")
def w2_series(spark, sf):
    return W.running_sum(supplier_series(spark, sf), "key", "t", "x").select("key", "t", F.round("running", 2).alias("running"))


def _ma_sql(w):
    return f"sum(x) over ({BY_T} rows between {w // 2} preceding and {(w - 1) // 2} following) / {w}.0"


@query("W3_centered_moving_average", SUP + f"select key, t, round({_ma_sql(4)}, 4) as ma4, round({_ma_sql(3)}, 4) as ma3 from series")
def w3(spark, sf):
    df = W.centered_ma(supplier_series(spark, sf), "key", "t", "x", 4, "ma4")
    return W.centered_ma(df, "key", "t", "x", 3, "ma3").select(
        "key", "t", F.round("ma4", 4).alias("ma4"), F.round("ma3", 4).alias("ma3"))


@query("W4_detrend", CUS + """,
core as (select key, t, x from series
  qualify t between min(t) filter (x <> 0) over (partition by key) and max(t) filter (x <> 0) over (partition by key)),
sized as (select *, least(4, count(*) over (partition by key)) as w from core)
select a.key, a.t, round(any_value(a.x) - sum(b.x) / any_value(a.w), 4) as detrended from sized a
join sized b on a.key = b.key and b.t between a.t - a.w // 2 and a.t + (a.w - 1) // 2 group by a.key, a.t""")
def w4(spark, sf):
    core = W.trim_trailing_zeros(
        W.trim_leading_zeros(customer_series(spark, sf), "key", "t", "x"), "key", "t", "x")
    return W.detrend(core, "key", "t", "x", 4).select("key", "t", F.round("detrended", 4).alias("detrended"))


@query("W5_rolling_std_filled", SUP + f""",
s as (select key, t, case when t >= 3 then stddev_samp(x) over ({BY_T} rows between 3 preceding and current row) end as sd from series)
select key, t, round(coalesce(sd, avg(sd) over (partition by key)), 3) as rolling_std from s""")
def w5(spark, sf):
    return W.rolling_std_filled(supplier_series(spark, sf), "key", "t", "x", 4).select(
        "key", "t", F.round("rolling_std", 3).alias("rolling_std"))


FLAGS_SQL = CUS + """, flags as (
  select key, t, 'zero' as type, 0.0 as ratio from series where x < 10
  union all select key, t, 'increase', round(x / 50000, 3) from series where x > 100000
  union all select key, t, 'season', 1.0 from series where x between 80000 and 150000) """


def _flags(spark, sf):
    s = customer_series(spark, sf)
    zero = s.where(F.col("x") < 10).select("key", "t", F.lit("zero").alias("type"), F.lit(0.0).alias("ratio"))
    up = s.where(F.col("x") > 100000).select(
        "key", "t", F.lit("increase").alias("type"), F.round(F.col("x") / 50000, 3).alias("ratio"))
    season = s.where(F.col("x").between(80000, 150000)).select("key", "t", F.lit("season").alias("type"), F.lit(1.0).alias("ratio"))
    return zero.unionByName(up).unionByName(season)


@query("W6_dedupe_keep_last", FLAGS_SQL + """
select key, t, type, ratio from flags qualify row_number() over (partition by key, t order by type desc) = 1""")
def w6(spark, sf):
    return W.dedupe_last(_flags(spark, sf), ["key", "t"], "type", "ratio")


CODES_SQL = CUS + f""", codes as (select key, t, case when x < 10 then 'zero' when x > 150000 then 'high' else 'mid' end as code from series),
runs as (select *, cast(sum(case when code is distinct from prev then 1 else 0 end) over ({BY_T}) as bigint) as run from (
  select *, lag(code) over ({BY_T}) as prev from codes)) """


def _codes(spark, sf):
    x = F.col("x")
    code = F.when(x < 10, "zero").when(x > 150000, "high").otherwise("mid")
    return customer_series(spark, sf).select("key", "t", code.alias("code"))


@query("W7_run_id", CODES_SQL + "select key, t, run from runs")
def w7(spark, sf):
    return W.run_id(_codes(spark, sf), "key", "t", "code").select("key", "t", "run")


@query("W8_run_length", CODES_SQL + "select key, t, count(*) over (partition by key, run) as run_length from runs")
def w8(spark, sf):
    return W.run_length(_codes(spark, sf), "key", "t", "code").select("key", "t", "run_length")


@query("W9_first_of_run", CODES_SQL + "select key, t, code from runs where prev is null or prev <> code")
def w9(spark, sf):
    return W.first_of_run(_codes(spark, sf), "key", "t", "code")


@query("W10_consecutive_groups", CUS + """
select key, min(t) as t, cast(count(*) >= 2 as int) as is_long from (
  select key, t, t - row_number() over (partition by key order by t) as g from series where x < 10) group by key, g""")
def w10(spark, sf):
    return W.consecutive_groups(customer_series(spark, sf).where(F.col("x") < 10), "key", "t")


@query("W11_trim_leading_zeros", CUS + """
select key, t, x from series qualify t >= coalesce(min(t) filter (x <> 0) over (partition by key), 0)""")
def w11(spark, sf):
    return W.trim_leading_zeros(customer_series(spark, sf), "key", "t", "x")


@query("W12_trim_trailing_zeros", CUS + """
select key, t, x from series qualify t <= coalesce(max(t) filter (x <> 0) over (partition by key), 1000)""")
def w12(spark, sf):
    return W.trim_trailing_zeros(customer_series(spark, sf), "key", "t", "x")


HOLES_SQL = SEG + ", holes as (select key, t, case when t >= 3 and t < 25 and t % 5 <> 0 then x end as x from series) "


def _holes(spark, sf):
    t = F.col("t")
    return segment_series(spark, sf).withColumn("x", F.when((t >= 3) & (t < 25) & (t % 5 != 0), F.col("x")))


@query("W13_fill_edges", HOLES_SQL + """
select key, t, coalesce(round(case when t < 3 then arg_min(x, t) filter (x is not null) over (partition by key)
  when t > 24 then arg_max(x, t) filter (x is not null) over (partition by key) else x end, 2), -1) as x from holes""")
def w13(spark, sf):
    out = W.fill_edges(_holes(spark, sf), "key", "t", "x")
    return out.select("key", "t", F.coalesce(F.round("x", 2), F.lit(-1.0)).alias("x"))


@query("W14_fill_interior", HOLES_SQL + f"""
select key, t, coalesce(round(coalesce(x, (lag(x) over ({BY_T}) + lead(x) over ({BY_T})) / 2), 3), -1) as x from holes""")
def w14(spark, sf):
    out = W.fill_interior(_holes(spark, sf), "key", "t", "x")
    return out.select("key", "t", F.coalesce(F.round("x", 3), F.lit(-1.0)).alias("x"))


@query("W15_differencing", SUP + f""",
d as (select key, t, x - lag(x) over ({BY_T}) as d1 from series)
select key, t, round(dd, 2) as diff from (select key, t, d1 - lag(d1, 12) over ({BY_T}) as dd from d) where t >= 13""")
def w15(spark, sf):
    out = W.difference(supplier_series(spark, sf), "key", "t", "x", d=1, seasonal_d=1, s=12)
    return out.select("key", "t", F.round("diff", 2).alias("diff"))


@query("W16_time_position", """
select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as position from events""")
def w16(spark, sf):
    return keyed_positions(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select(
        "event_id", "user_id", "position")


@query("W16_time_position_series", SEG + f"select key, t, row_number() over ({BY_T}) - 1 as idx from series")
def w16_series(spark, sf):
    return W.t_index(segment_series(spark, sf), "key", "t").select("key", "t", F.col("idx").cast("long"))
