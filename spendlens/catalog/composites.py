"""Composite jobs."""

from pyspark.sql import functions as F

from .. import frames
from ..frames import (
    CHANGE_TYPES, CUSTOMER_SQL, CUTOFF, CYCLES_SQL, FIRST_MONTH, FIRST_QUARTER, FIRST_YEAR, LAST_MONTH, LAST_QUARTER,
    MART_SQL, SUMMARY_SQL, SUPPLIER_SQL, customer_series, cycles, mart_rows, summary, supplier_series,
)
from .. import plans
from ..plans.anomalies import anomaly_lists
from ..plans.churn import TYPE_PAIRS, active_rows
from ..plans.rollup import ROLLUP_KEYS, ROLLUP_SUMS
from ..session import cut_lineage
from .joins import CHANGES_SQL, COMMENTS_SQL, EXCLUDED_SQL
from .reshapes import MONEY_MEAN, ORDERED_SQL, spread_sql
from . import query
from . import series_sql as Q

CLEAN_SQL = CYCLES_SQL + f""",
offered as (select * from cycles where master_id not in (select master_id from cycles where offer_name is null)),
swapped as (select cycle_id, master_id, budget, case when ended < started then ended else started end as s,
  case when ended < started then started else ended end as e from offered),
kept as (select *, date_diff('day', s, e) as d from swapped
  where coalesce(budget >= 1, true) and coalesce(s <> date '{CUTOFF}', true)),
dated as (select * from kept where master_id not in (select master_id from kept where s is null)),
usual as (select d from dated where d is not null group by 1 order by count(*) desc, d limit 1),
clean as (select cycle_id, master_id, budget, s, coalesce(e, s + cast((select d from usual) as int)) as e,
  cast(coalesce(d, (select d from usual)) as bigint) as duration from dated)"""


@query("C1_clean_cycles", "with " + CLEAN_SQL + """
select cycle_id, master_id, budget, cast(s as varchar) as started, cast(e as varchar) as ended, duration from clean""")
def c1(spark, sf):
    return plans.clean_cycles(cycles(spark, sf), CUTOFF, unused=("state",)).select(
        "cycle_id", "master_id", "budget", F.col("started").cast("string"), F.col("ended").cast("string"), "duration")


def _dense_sql(dim, grain, first, last, value, source):
    return f"""v as ({value}),
dense as (select k.{dim}, g.b, coalesce(v.value, 0.0) as value from (select distinct {dim} from {source}) k
  cross join (select unnest(range({first}, {last + 1})) as b) g left join v on v.{dim} = k.{dim} and v.b = g.b)"""


MEAN_QUARTER = f"""select category, year(s) * 4 + quarter(s) - 1 as b, {MONEY_MEAN} as value from ordered
  where date_trunc('quarter', s) = date_trunc('quarter', e) group by all"""
ALL_SQL = ORDERED_SQL + ", everyone as (select coalesce(category, 'Other') as category, master_id, state from cycles)"


@query("C2_budget_matrix_by_category", "with " + ALL_SQL + ", "
       + _dense_sql("category", "quarter", FIRST_QUARTER, LAST_QUARTER, MEAN_QUARTER, "everyone")
       + " select category, (b // 4) || '-Q' || (b % 4 + 1) as bucket, value from dense")
def c2(spark, sf):
    return plans.budget_matrix(
        cycles(spark, sf), "category", "quarter", FIRST_QUARTER, LAST_QUARTER, "mean", end="short_end"
    ).select("category", "bucket", "value")


MEAN_MONTH = f"""select state, year(s) * 12 + month(s) - 1 as b, {MONEY_MEAN} as value
  from (select o.*, c.state from ordered o join cycles c using (cycle_id))
  where date_trunc('month', s) = date_trunc('month', e) group by all"""


@query("C2_budget_matrix_by_state_month", "with " + ALL_SQL + ", "
       + _dense_sql("state", "month", FIRST_MONTH, LAST_MONTH, MEAN_MONTH, "everyone")
       + " select state, (b // 12) || '-M' || (b % 12 + 1) as bucket, value from dense")
def c2_state(spark, sf):
    return plans.budget_matrix(
        cycles(spark, sf), "state", "month", FIRST_MONTH, LAST_MONTH, "mean", end="short_end"
    ).select("state", "bucket", "value")


PRORATED_QUARTER = """select master_id, bucket_idx as b, cast(sum(cast(budget as decimal(18,2))
    * date_diff('day', greatest(s, lo), least(e, nxt))) as double) / date_diff('day', any_value(lo), any_value(nxt)) as value
  from touched group by all"""


@query("C2_budget_matrix_by_advertiser", "with " + spread_sql("quarter")
       + ", everyone as (select master_id from cycles), "
       + _dense_sql("master_id", "quarter", FIRST_QUARTER, LAST_QUARTER, PRORATED_QUARTER, "everyone")
       + " select master_id, (b // 4) || '-Q' || (b % 4 + 1) as bucket, round(value, 6) as value from dense")
def c2_advertiser(spark, sf):
    return plans.budget_matrix(
        cycles(spark, sf), "master_id", "quarter", FIRST_QUARTER, LAST_QUARTER, "prorated", end="short_end"
    ).select("master_id", "bucket", F.round("value", 6).alias("value"))


# the spectrum of a 0/1 series from its intervals: geometric sums instead of a transform; the moving average is a factor per
# bin, less the three of its values that lie outside the series
C3_CYCLES_SQL = "with " + CYCLES_SQL + """,
ordered as (select *, lag(e) over w as prev_end, min(s) over (partition by master_id) as first_start,
    last_value(e) over (partition by master_id order by s, e, cycle_id rows between unbounded preceding and unbounded following) as last_end
  from (select cycle_id, master_id, started as s, short_end as e from cycles where started is not null and short_end is not null and master_id is not null)
  window w as (partition by master_id order by s, e, cycle_id)),
sized as (select master_id, count(*) as cycles, max(date_diff('day', first_start, last_end)) as n from ordered group by 1),
gaps as (select master_id, date_diff('day', first_start, prev_end) as lo, date_diff('day', first_start, s) as hi from ordered where s > prev_end),
spans as (select z.*, cast(pow(2, ceil(log2(n))) as bigint) as nfft,
    case when exists (select 1 from gaps g where g.master_id = z.master_id and g.lo <= 0 and g.hi > 0) then 0 else 1 end as x0,
    case when exists (select 1 from gaps g where g.master_id = z.master_id and g.lo <= n - 1 and g.hi > n - 1) then 0 else 1 end as x1,
    case when exists (select 1 from gaps g where g.master_id = z.master_id and g.lo <= n - 2 and g.hi > n - 2) then 0 else 1 end as x2
  from sized z where cycles >= 4 and n >= 4),
parts as (select master_id, 0 as lo, n as hi, 1 as sgn from spans union all select g.master_id, lo, hi, -1 from gaps g join spans using (master_id)),
bins as (select *, unnest(range(0, nfft // 2 + 1)) as k from spans),
summed as (select b.master_id, b.k, any_value(b.n) as n, any_value(b.nfft) as nfft, any_value(x0) as x0, any_value(x1) as x1, any_value(x2) as x2,
    2 * pi() * b.k / any_value(b.nfft) as th, sum(sgn * (hi - lo)) as days,
    sum(sgn * (cos(2 * pi() * ((lo * b.k) % nfft) / nfft) - cos(2 * pi() * ((hi * b.k) % nfft) / nfft))) as u,
    sum(sgn * (sin(2 * pi() * ((hi * b.k) % nfft) / nfft) - sin(2 * pi() * ((lo * b.k) % nfft) / nfft))) as v
  from bins b join parts p on p.master_id = b.master_id group by b.master_id, b.k),
waves as (select *, case when k = 0 then days else (u * (1 - cos(th)) + v * sin(th)) / (2 - 2 * cos(th)) end as xr,
    case when k = 0 then 0 else (v * (1 - cos(th)) - u * sin(th)) / (2 - 2 * cos(th)) end as xi,
    1 - (2 * cos(th) + 1 + cos(2 * th)) / 4 as hr, sin(2 * th) / 4 as hi,
    x0 / 4.0 * cos(th) + (x1 + x2) / 4.0 * cos(th * n) + x1 / 4.0 * cos(th * (n + 1)) as cr,
    x0 / 4.0 * sin(th) - (x1 + x2) / 4.0 * sin(th * n) - x1 / 4.0 * sin(th * (n + 1)) as ci from summed),
raw as (select master_id, k, nfft, pow(xr * hr - xi * hi + cr, 2) + pow(xr * hi + xi * hr + ci, 2) as p from waves),
scaled as (select *, (p - min(p) over (partition by master_id)) / (max(p) over (partition by master_id) - min(p) over (partition by master_id)) as power from raw),
best as (select master_id, arg_max(k, (floor(power * 1e9 + 0.5), -k)) as bin, regr_slope(power, (nfft - 2.0) / k) as slope, any_value(nfft) as nfft
  from scaled where k > 0 and k < nfft // 2 group by 1)
select z.master_id, coalesce(cast(abs(slope) > 0.001 as int), 0) as seasonal,
  coalesce(round(case when abs(slope) > 0.001 then (nfft - 2.0) / bin end, 4), 0.0) as period, coalesce(round(slope, 6), 0.0) as slope
from sized z left join best using (master_id)"""


@query("C3_seasonality_of_cycles", C3_CYCLES_SQL)
def c3_cycles(spark, sf):
    return plans.detect_cycle_seasonality(cycles(spark, sf), "master_id", "started", "short_end").select(
        "master_id", "seasonal", F.round("period", 4).alias("period"), F.round("slope", 6).alias("slope"))


def _season_sql(series):
    return f"with {series}, {Q.detrended('series', 'det')}, {Q.spectrum('det', 'spec')}, {Q.best_bin('spec', 'best', 1)}"


@query("C3_seasonality_of_series", _season_sql(CUSTOMER_SQL) + """,
fit as (select key, regr_slope(power, (nfft - 2.0) / bin) as slope from spec where bin > 0 group by 1)
select k.key, coalesce(cast(abs(f.slope) > 0.001 as int), 0) as seasonal,
  case when abs(f.slope) > 0.001 then round((b.nfft - 2) / b.bin, 4) else 0.0 end as period
from (select distinct key from series) k left join fit f on f.key = k.key left join best b on b.key = k.key""")
def c3_series(spark, sf):
    return plans.detect_series_seasonality(customer_series(spark, sf), "key").select(
        "key", "seasonal", F.round("period", 4).alias("period"))


@query("C3_seasonality_by_ks_test", f"""with {CUSTOMER_SQL}, {Q.detrended('series', 'det')}, {Q.spectrum('det', 'spec')}, {Q.best_bin('spec', 'best')},
d as (select key, max(greatest(i / n - power, power - (i - 1) / n)) as distance, max(n) as n from (
  select key, power, cast(row_number() over (partition by key order by power) as double) as i,
    cast(count(*) over (partition by key) as double) as n from spec) group by 1),
p as (select d.key, greatest(0.0, least(1.0, case when any_value(distance) * sqrt(any_value(n)) < 0.2 then 1.0
    else sum(case when k % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * k * k * distance * distance * n)) end)) as p
  from d cross join (select unnest(range(1, 101)) as k) group by d.key),
f as (select b.key, b.nfft, b.bin, p.p < 0.05 and b.bin <> 0 as hit from best b join p on p.key = b.key)
select k.key, coalesce(cast(f.hit as int), 0) as seasonal, coalesce(case when f.hit then round((f.nfft - 2) / f.bin, 4) end, 0.0) as period
from (select distinct key from series) k left join f on f.key = k.key""")
def c3_ks(spark, sf):
    return plans.detect_series_seasonality(customer_series(spark, sf), "key", test="ks").select(
        "key", "seasonal", F.round("period", 4).alias("period"))


DETECTED = """select r.key, p.period, r.idx, r.type, round(r.ratio, 3) as ratio from runs r join periods p on p.key = r.key"""


@query("C4_anomalies_of_customers", Q.whole_detector(CUSTOMER_SQL) + DETECTED)
def c4(spark, sf):
    return plans.detect_anomalies(customer_series(spark, sf), "key").select(
        "key", "period", F.col("idx").cast("long"), "type", F.round("ratio", 3).alias("ratio"))


@query("C4_anomalies_of_suppliers", Q.whole_detector(SUPPLIER_SQL) + DETECTED)
def c4_suppliers(spark, sf):
    return plans.detect_anomalies(supplier_series(spark, sf), "key").select(
        "key", "period", F.col("idx").cast("long"), "type", F.round("ratio", 3).alias("ratio"))


@query("C4_anomaly_lists", Q.whole_detector(SUPPLIER_SQL) + """
select p.key, p.period, array_to_string(list(r.idx order by r.idx), ',') as flags,
  array_to_string(list(r.type order by r.idx), ',') as types,
  array_to_string(list(case when isinf(r.ratio) then -1 else cast(round(r.ratio * 1000) as bigint) end order by r.idx), ',') as ratios
from periods p join runs r on r.key = p.key group by 1, 2""")
def c4_lists(spark, sf):
    found = anomaly_lists(plans.detect_anomalies(supplier_series(spark, sf), "key"), "key")
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    # ratios as thousandths, infinite ones as -1
    whole = lambda r: F.when(r == float("inf"), F.lit(-1)).otherwise(F.round(r * 1000)).cast("long")
    return found.withColumn("ratios", F.transform("ratios", whole)).select(
        "key", "period", joined("flags"), joined("types"), joined("ratios"))


@query("C4_anomalies_adjacent_runs", Q.whole_detector(CUSTOMER_SQL) + """,
a as (select *, sum(case when type is distinct from prev then 1 else 0 end) over (partition by key order by t rows unbounded preceding) as run
  from (select *, lag(type) over (partition by key order by t) as prev from final)),
b as (select key, t, case when type = 'zero' and count(*) over (partition by key, run) > 2 then 'offline' else type end as type from a),
c as (select key, t, type, lag(type) over (partition by key order by t) as prev from b),
d as (select key, t, type, lag(type) over (partition by key order by t) as before,
  count(*) over (partition by key) as n, row_number() over (partition by key order by t desc) as back
  from c where prev is null or prev <> type)
select d.key, p.period, d.t as idx, d.type from d join periods p on p.key = d.key
where not (n > 2 and back = 1 and coalesce(before, '') = 'offline')""")
def c4_adjacent(spark, sf):
    return plans.detect_anomalies(customer_series(spark, sf), "key", method="adjacent").select(
        "key", "period", F.col("idx").cast("long"), "type")


def _lowess_sql(w: int, k: float, flagged: str) -> str:
    """Pauses between peaks (also after the last) and points off a local regression, as (key, period, t)."""
    return f"""with {SUPPLIER_SQL}, {Q.trimmed('series')}, {Q.detrended('core', 'det', w)}, {Q.spectrum('det', 'spec')}, {Q.best_bin('spec', 'best')},
periods as (select k.key, {Q.period_ceil('b')} as period from (select distinct key from body) k left join best b on b.key = k.key),
withp as (select s.key, s.t, s.x, p.period from body s join periods p on p.key = s.key),
{Q.extrema('withp', 'ext')}, {Q.trend('withp', 'tr')}, {Q.lowess('tr', 'fit', 'coalesce(trend, x)')},
late as (select e.key, e.t from (select key, t, lead(t) over (partition by key order by t) as nxt from ext where is_peak) e
  join (select key, any_value(period) as period, count(*) as n from withp group by key) p on p.key = e.key
  where coalesce((nxt - e.t) / period >= {k}, (n - e.t) / period >= 2.0)),
off as (select tr.key, tr.t, tr.x, coalesce(tr.trend, tr.x) as trend, fit.smooth from tr join fit on fit.key = tr.key and fit.t = tr.t),
hit as (select key, t from ({flagged}) union select key, t from late)"""


@query("C4_anomalies_by_lowess", _lowess_sql(12, 2.0, """
select key, t from (select *, abs(smooth - trend) as d, max(abs(smooth - trend)) over (partition by key) as m from off) where m > 0 and d / m > 0.8""") + """
select h.key, p.period, cast(h.t as int) as idx, 'deviation' as type from hit h join periods p on p.key = h.key""")
def c4_lowess(spark, sf):
    return plans.detect_anomalies(supplier_series(spark, sf), "key", w=12, threshold=0.8, method="lowess").select(
        "key", "period", "idx", "type")


@query("C4_anomalies_by_lowess_signal", _lowess_sql(4, 1.5, """
select key, t from (select *, abs(smooth - x) as d, stddev_pop(abs(smooth - x)) over (partition by key) as m from off) where m > 0 and d / m > 1.25""") + """
select h.key, p.period, cast(min(h.t) as int) as idx, 'deviation' as type
from (select *, t - row_number() over (partition by key order by t) as island from hit) h join periods p on p.key = h.key group by h.key, p.period, island""")
def c4_lowess_signal(spark, sf):
    return plans.detect_anomalies(supplier_series(spark, sf), "key", threshold=1.25, method="lowess_signal").select(
        "key", "period", "idx", "type")


FIRST_DAY, LAST_DAY = f"{FIRST_YEAR}-01-01", "2001-03-31"


def _masters(spark, sf):
    return plans.eligible_masters(summary(spark, sf), frames.excluded_businesses(spark, sf), FIRST_YEAR)


def _comments(spark, sf, masters=None):
    return plans.comment_summary(
        frames.comments(spark, sf), frames.campaigns(spark, sf), frames.advertiser_masters(spark, sf),
        FIRST_DAY, LAST_DAY, _masters(spark, sf) if masters is None else masters)


MART_BASE = SUMMARY_SQL + ", " + CHANGES_SQL + ", " + COMMENTS_SQL + f""",
masters as (select distinct idcampaign_master from summary where csr_year >= {FIRST_YEAR} and net_cost > 0
  and idbusiness not in ({EXCLUDED_SQL})),
notes as (select cast(year(c.cc_entered) as int) as cc_year, cast(month(c.cc_entered) as int) as cc_month, o.m as mcid, c.idcampaign as cid,
    any_value('C' || o.o_orderkey) as campaign_name, any_value(o.o_custkey) as maid,
    count(*) filter (c.user_id <> 1) as businessuser, count(*) filter (c.user_id = 1) as system,
    max(case when c.cc_comment like '*USER STOP REQUEST*%' then 1 else 0 end) as stop_request,
    any_value(o.o_custkey % 100) as idoffer
  from comments c join (select *, o_custkey * 10 + cast(substr(o_orderpriority, 1, 1) as int) as m from orders) o on o.o_orderkey = c.idcampaign
  join customer k on k.c_custkey = o.o_custkey
  where o.m in (select idcampaign_master from masters) and c.cc_entered between date '{FIRST_DAY}' and date '{LAST_DAY}'
  group by 1, 2, 3, 4)"""


@query("C5_eligible_masters", "with " + MART_BASE + " select idcampaign_master from masters")
def c5_masters(spark, sf):
    return _masters(spark, sf)


@query("C5_comment_summary", "with " + MART_BASE + " select * from notes")
def c5_comments(spark, sf):
    return _comments(spark, sf)


FULL_MART_SQL = MART_BASE + f""",
base as (
  select s.csr_year, s.csr_month, s.idcampaign,
    min(case when net_cost + net_cost_adjustment < 0 then 0 else net_cost + net_cost_adjustment end) as spend,
    min(s.idcampaign_master) as idcampaign_master, min(s.idadvertiser) as idadvertiser, min(c.c_name) as advertiser_name,
    min('City ' || c.c_custkey % 50) as advertiser_city, min(n.n_name) as advertiser_state,
    min(lpad(cast(c.c_custkey as varchar), 5, '0')) as advertiser_zipcode,
    min(length(c.c_mktsegment)) as idbusinesscategory, min(c.c_mktsegment) as business_category,
    min(cast(c.c_nationkey as bigint)) as idbusinesssubcategory,
    min(c.c_mktsegment || ' in ' || n.n_name) as business_subcategory, min(s.idoffer) as idoffer,
    min(p.s_name) as product, min(h.change_type) as adv_change_type, min(s.campaign_budget) as campaign_budget,
    min(s.clicks) as clicks, min(s.impressions) as impressions, min(s.calls) as calls,
    min(s.qualified_calls) as qualified_calls, min(s.emails) as emails, min(s.cvt) as cvt,
    min(s.qualified_web_events) as qualified_web_events
  from summary s join orders r on r.o_orderkey = s.idcampaign and r.o_orderstatus <> 'P'
  join customer c on c.c_custkey = s.idadvertiser join nation n on n.n_nationkey = c.c_nationkey
  join changes h on h.first_aid = s.idadvertiser_master and h.y = s.csr_year and h.m = s.csr_month
  join supplier p on p.s_suppkey = s.idoffer
  where s.csr_year >= {FIRST_YEAR} and s.idcampaign_master in (select idcampaign_master from masters)
  group by 1, 2, 3),
churn_mart as (
  select b.*, n.stop_request, n.businessuser, n.system, cast(exists (select 1 from lineitem l where l.l_returnflag = 'R'
    and l.l_orderkey = b.idcampaign and year(l.l_shipdate) = b.csr_year and month(l.l_shipdate) = b.csr_month) as int) as advtrans
  from base b left join notes n on n.cc_year = b.csr_year and n.cc_month = b.csr_month and n.cid = b.idcampaign)"""


def _mart(spark, sf):
    masters = cut_lineage(_masters(spark, sf))  # used twice: stored once, as a plain list of ids
    return plans.build_churn_mart(
        summary(spark, sf), masters, frames.report(spark, sf), frames.advertisers(spark, sf),
        frames.changes(spark, sf), frames.offers(spark, sf), _comments(spark, sf, masters),
        plans.transfer_keys(frames.transfer_log(spark, sf), FIRST_YEAR), FIRST_YEAR)


@query("C5_churn_mart", "with " + FULL_MART_SQL + """
select * replace (coalesce(stop_request, -1) as stop_request, coalesce(businessuser, -1) as businessuser,
  coalesce(system, -1) as system) from churn_mart""")
def c5(spark, sf):
    # missing comment counts are shown as -1, so that both engines return whole numbers
    return _mart(spark, sf).na.fill({"stop_request": -1, "businessuser": -1, "system": -1})


@query("C5_mart_key_violations", "with " + FULL_MART_SQL + """
select cast(sum(n) as bigint) as mart_rows, count(*) as keys, count(*) filter (n > 1) as violations
from (select count(*) as n from churn_mart group by csr_year, csr_month, idcampaign)""")
def c5_keys(spark, sf):
    keys = _mart(spark, sf).groupBy("csr_year", "csr_month", "idcampaign").agg(F.count("*").alias("n"))
    return keys.agg(F.sum("n").alias("mart_rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("violations"))


ROLL_KEYS = ("idadvertiser", "idcampaign_master", "idcampaign", "advertiser_state")
ROLL_SUMS = ("clicks", "calls", "impressions", "stop_request")


def _export_shape(spark, sf):
    """Mart rows as text, with name suffix and null marker."""
    rows = mart_rows(spark, sf)
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    marked = text.withColumn("adv_change_type", F.when(F.col("adv_change_type") == "New", "\\N").otherwise(
        F.col("adv_change_type")))
    return marked.toDF(*[f"{c}_varchar" for c in marked.columns])


@query("C6_tidy_mart", "with " + MART_SQL + """
select cast(idcampaign as double) as idcampaign, cast(csr_year as double) as csr_year, cast(csr_month as double) as csr_month,
  cast(clicks as double) as clicks, advertiser_state, adv_change_type, campaign_budget from mart where adv_change_type <> 'New'""")
def c6_tidy(spark, sf):
    return plans.tidy_mart(_export_shape(spark, sf)).select(
        "idcampaign", "csr_year", "csr_month", "clicks", "advertiser_state", "adv_change_type", "campaign_budget")


ROLLED_SQL = """rolled as (select idadvertiser, idcampaign_master, idcampaign, advertiser_state, cast(sum(clicks) as bigint) as clicks,
  cast(sum(calls) as bigint) as calls, cast(sum(impressions) as bigint) as impressions,
  cast(coalesce(sum(stop_request), 0) as bigint) as stop_request, max(csr_year) as csr_year from mart group by 1, 2, 3, 4)"""


@query("C6_campaign_rollup", "with " + MART_SQL + ", " + ROLLED_SQL + " select * from rolled")
def c6_rollup(spark, sf):
    return plans.campaign_rollup(mart_rows(spark, sf), ROLL_KEYS, ROLL_SUMS, "csr_year")


@query("C6_cycles_with_rollup", "with " + CYCLES_SQL + ", " + MART_SQL + ", " + ROLLED_SQL + """
select c.cycle_id, c.budget, coalesce(r.clicks, -1) as clicks, coalesce(r.impressions, -1) as impressions
from (select * from cycles where budget <> 0) c left join rolled r using (idadvertiser, idcampaign_master, idcampaign)""")
def c6_join(spark, sf):
    rolled = plans.campaign_rollup(mart_rows(spark, sf), ROLL_KEYS, ROLL_SUMS, "csr_year")
    return plans.join_rollup(cycles(spark, sf), rolled).select(
        "cycle_id", "budget", F.coalesce("clicks", F.lit(-1)).alias("clicks"),
        F.coalesce("impressions", F.lit(-1)).alias("impressions"))


FULL_ROLLED_SQL = "rolled as (select " + ", ".join(ROLLUP_KEYS) + ", " + ", ".join(
    f"cast(coalesce(sum({c}), 0) as bigint) as {c}" for c in ROLLUP_SUMS) + ", max(advtrans) as advtrans from churn_mart group by all)"


@query("C6_rollup_of_mart", "with " + FULL_MART_SQL + ", " + FULL_ROLLED_SQL + " select * from rolled")
def c6_mart_rollup(spark, sf):
    return plans.campaign_rollup(_mart(spark, sf))


@query("C6_cycles_with_rollup_of_mart", "with " + CYCLES_SQL + ", " + FULL_MART_SQL + ", " + FULL_ROLLED_SQL + """
select c.cycle_id, c.budget, coalesce(r.product, '') as product, coalesce(r.qualified_calls, -1) as qualified_calls,
  coalesce(r.businessuser, -1) as businessuser
from (select * from cycles where budget <> 0) c left join rolled r using (idadvertiser, idcampaign_master, idcampaign)""")
def c6_mart_join(spark, sf):
    return plans.join_rollup(cycles(spark, sf), plans.campaign_rollup(_mart(spark, sf))).select(
        "cycle_id", "budget", F.coalesce("product", F.lit("")).alias("product"),
        F.coalesce("qualified_calls", F.lit(-1)).alias("qualified_calls"),
        F.coalesce("businessuser", F.lit(-1)).alias("businessuser"))


def _profile_sql():
    gone = "gone as (select * from mart where idadvertiser in (select idadvertiser from mart where adv_change_type = 'Churn'))"
    sets = "sets as (select idadvertiser, list(distinct adv_change_type) as ts from gone group by 1)"
    parts = [f"select 'ever' as section, '{v}' as item, count(*) filter (list_contains(ts, '{v}')) as keys from sets"
             for v in CHANGE_TYPES]
    for word, op in (("both", "and"), ("either", "or")):
        parts += [f"select '{word}', '{a} + {b}', count(*) filter (list_contains(ts, '{a}') {op} list_contains(ts, '{b}')) from sets"
                  for a, b in TYPE_PAIRS]
    for dim in ("advertiser_state", "business_category"):
        parts.append(f"select '{dim}', {dim}, count(distinct idadvertiser) from gone group by 2")
        parts.append(f"select 'ambiguous', '{dim}', count(*) from (select idadvertiser from gone group by 1 "
                     f"having count(distinct {dim}) > 1)")
    return "with " + MART_SQL + f", {gone}, {sets} " + " union all ".join(parts)


@query("C7_churn_profile", _profile_sql())
def c7(spark, sf):
    return plans.churn_profile(mart_rows(spark, sf))


@query("C7_active_rows", "with " + MART_SQL + " select idcampaign, csr_year, csr_month from mart where campaign_budget <> 0 and spend <> 0")
def c7_active(spark, sf):
    return active_rows(mart_rows(spark, sf)).select("idcampaign", "csr_year", "csr_month")


@query("C7_change_types", f"""with {CUSTOMER_SQL},
firsts as (select key, min(t) as t0 from series where x > 0 group by 1),
lasts as (select s.key, s.t, max(b.t) as busy from series s join firsts f on f.key = s.key and s.t > f.t0
  join series b on b.key = s.key and b.t < s.t and b.x > 0 group by 1, 2)
select s.key, s.t, s.x as budget, coalesce(p.x, -1.0) as previous,
  case when s.t = f.t0 then 'New' when s.x > 0 and p.x = 0 then 'Idle up' when s.x > p.x and s.x > 0 then 'Change up'
    when s.x > 0 and s.x < p.x then 'Change down' when s.x > 0 then 'No change' when s.t - l.busy = 1 then 'Idle down' else 'Churn' end as change_type
from series s join firsts f on f.key = s.key and s.t >= f.t0 left join series p on p.key = s.key and p.t = s.t - 1
left join lasts l on l.key = s.key and l.t = s.t where s.x > 0 or s.t - l.busy <= 2""")
def c7_change_types(spark, sf):
    return plans.change_types(customer_series(spark, sf), "key").withColumn("previous", F.coalesce("previous", F.lit(-1.0)))


C8_SQL = "with " + CYCLES_SQL + """,
total as (select master_id from cycles group by 1 having max(cast(budget = 0 as int)) = 1 and sum(cast(budget as decimal(18,2))) = 0),
zero as (select distinct master_id from cycles where budget = 0 and master_id not in (select master_id from total)),
s as (select master_id as key, cycle_id, budget as x from cycles where master_id in (select master_id from zero)),
series as (select key, row_number() over (partition by key order by cycle_id) - 1 as t, x from s),
c as (select key, t, x - avg(x) over (partition by key) as c, count(*) over (partition by key) as n from series),
r as (select a.key, a.lag, any_value(a.n) as n, sum(a.c * b.c) as num
  from (select *, unnest(range(0, n)) as lag from c) a join c b on b.key = a.key and b.t = a.t + a.lag group by 1, 2),
f as (select key, lag, n, case when max(num) filter (lag = 0) over (partition by key) > 0
  then num / max(num) filter (lag = 0) over (partition by key) end as r from r),
q as (select *, sqrt((1 + 2 * coalesce(sum(case when lag > 0 then r * r end) over (partition by key order by lag
  rows between unbounded preceding and 1 preceding), 0)) / n) as se from f) """


@query("C8_zero_budget_profile", C8_SQL + """
select key as master_id, max(n) as n, count(*) filter (lag > 0 and abs(r) > 1.959963984540054 * se) as lags,
  cast(count(*) filter (lag > 0 and abs(r) > 1.959963984540054 * se) > 0 as int) as flag from q group by 1""")
def c8(spark, sf):
    return plans.zero_budget_profile(cycles(spark, sf), "master_id", "budget", ["cycle_id"])


@query("C8_zero_budget_profile_legacy", C8_SQL + """
select key as master_id, max(n) as n, cast(max(n) >= 2 and max(r) is not null as int) as flag from q group by 1""")
def c8_legacy(spark, sf):
    return plans.zero_budget_profile(cycles(spark, sf), "master_id", "budget", ["cycle_id"], mode="legacy").select(
        "master_id", "n", "flag")
