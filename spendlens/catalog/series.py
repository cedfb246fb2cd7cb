"""Time-series operators."""

from pyspark.sql import functions as F

from ..frames import CUSTOMER_SQL, CYCLES_SQL, SEGMENT_SQL, SUPPLIER_SQL, customer_series, cycles, segment_series, supplier_series, table
from ..functions import dominant, next_pow2, rescale
from ..operators import anomaly as N
from ..operators import grouped as G
from ..operators import spectral as S
from ..operators import windows as W
from . import query
from . import series_sql as Q

SUP, CUS, SEG = (f"with {sql}" for sql in (SUPPLIER_SQL, CUSTOMER_SQL, SEGMENT_SQL))
SPEC_SQL = SUP + f", {Q.detrended('series', 'det')}, {Q.spectrum('det', 'spec')}"


def spectrum(spark, sf):
    return S.detrended_spectrum(supplier_series(spark, sf), "key")


# one zero-length day range per cycle start is possible, so the number of cells is checked too
GAP_SQL = "with " + CYCLES_SQL + """,
ordered as (select *, lag(e) over w as prev_end, min(s) over (partition by master_id) as first_start,
    last_value(e) over (partition by master_id order by s, e, cycle_id rows between unbounded preceding and unbounded following) as last_end
  from (select cycle_id, master_id, started as s, short_end as e from cycles where started is not null and short_end is not null)
  window w as (partition by master_id order by s, e, cycle_id)),
days as (select distinct master_id, unnest(range(0, date_diff('day', first_start, last_end))) as t from ordered),
idle as (select distinct master_id, unnest(range({lo}, {lo} + date_diff('day', prev_end, s))) as t from ordered where s > prev_end),
series as (select d.master_id, d.t, case when i.t is null then 1 else 0 end as x from days d left join idle i using (master_id, t))
select master_id, count(*) as days, count(*) filter (x = 0) as idle_days, cast(coalesce(sum(t) filter (x = 0), 0) as bigint) as idle_sum from series group by 1"""


def _gap_totals(df):
    idle = F.col("x") == 0
    return df.groupBy("master_id").agg(
        F.count("*").alias("days"), F.count_if(idle).alias("idle_days"),
        F.coalesce(F.sum(F.when(idle, F.col("t"))), F.lit(0)).cast("long").alias("idle_sum"))


@query("T1_gap_series", GAP_SQL.replace("{lo}", "date_diff('day', first_start, prev_end)"))
def t1(spark, sf):
    return _gap_totals(S.gap_series(cycles(spark, sf), "master_id", "started", "short_end"))


@query("T1_gap_series_legacy", GAP_SQL.replace("{lo}", "date_diff('day', first_start, e)"))
def t1_legacy(spark, sf):
    return _gap_totals(S.gap_series(cycles(spark, sf), "master_id", "started", "short_end", mode="legacy"))


@query("T1_gap_intervals", "with " + CYCLES_SQL + """,
ordered as (select master_id, s, e, lag(e) over (partition by master_id order by s, e, cycle_id) as prev_end,
    min(s) over (partition by master_id) as first_start
  from (select cycle_id, master_id, started as s, short_end as e from cycles where started is not null and short_end is not null))
select master_id, date_diff('day', first_start, prev_end) as lo, date_diff('day', first_start, s) as hi from ordered where s > prev_end""")
def t1_intervals(spark, sf):
    spans = S.gap_intervals(cycles(spark, sf), "master_id", "started", "short_end")
    return spans.select("master_id", F.inline("gaps")).select("master_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


HOURS_SQL = """seen as (select distinct user_id as key, cast(floor(epoch(ts) / 3600) as bigint) as h from events),
hours as (select key, h0, unnest(range(h0, h1 + 1)) as h from (select key, min(h) as h0, max(h) as h1 from seen group by 1)),
series as (select g.key, g.h - g.h0 as t, cast(case when s.h is null then 0 else 1 end as double) as x from hours g left join seen s using (key, h))"""


def hourly(spark, sf):
    return S.activity_series(
        table(spark, sf, "events").withColumnRenamed("user_id", "key"), "key",
        F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600))


@query("T1_activity_series", "with " + HOURS_SQL + " select key, t, x from series")
def t1_hours(spark, sf):
    return hourly(spark, sf)


@query("T2_power_spectrum", SPEC_SQL + " select key, nfft, bin, round(power, 5) as power from spec")
def t2(spark, sf):
    return spectrum(spark, sf).select(
        "key", F.col("nfft").cast("long"), F.col("bin").cast("long"), F.round("power", 5).alias("power"))


@query("T2_power_spectrum_long", "with " + HOURS_SQL + f", {Q.detrended('series', 'det')}, {Q.spectrum('det', 'spec')}"
       + " select key, nfft, bin, round(power, 5) as power from spec")
def t2_long(spark, sf):
    return S.detrended_spectrum(hourly(spark, sf), "key").select(
        "key", F.col("nfft").cast("long"), F.col("bin").cast("long"), F.round("power", 5).alias("power"))


@query("T3_frequency_grid", SPEC_SQL + """
select key, bin, round(case when bin = 0 then 0 else 1.0 / ((nfft - 2.0) / bin) end, 8) as freq,
  round(case when bin = 0 then 0 else (nfft - 2.0) / bin end, 6) as period from spec""")
def t3(spark, sf):
    return spectrum(spark, sf).select(
        "key", F.col("bin").cast("long"), F.round("freq", 8).alias("freq"),
        F.coalesce(F.round("period", 6), F.lit(0.0)).alias("period"))


def _dominant(spark, sf, variant):
    det = W.detrend(supplier_series(spark, sf), "key", "t", "x", 4)
    return S.dominant_period(det, "key", "t", "detrended", variant).select(
        "key", F.col("bin").cast("long"), F.round("period", 6).alias("period"))


ALL_KEYS = "(select distinct key from series) k left join best b on b.key = k.key"


@query("T4_dominant_period", SPEC_SQL + f", {Q.best_bin('spec', 'best')} select k.key, coalesce(b.bin, 0) as bin, {Q.period_ceil()} as period from {ALL_KEYS}")
def t4(spark, sf):
    return _dominant(spark, sf, "ceil")


@query("T5_dominant_period_raw", SPEC_SQL + f", {Q.best_bin('spec', 'best')}" + f"""
select k.key, b.bin, case when b.bin = 0 then 'Infinity'::double else round((b.nfft - 2) / b.bin, 6) end as period from {ALL_KEYS}""")
def t5(spark, sf):
    return _dominant(spark, sf, "raw")


@query("T6_dominant_period_without_constant", SPEC_SQL + f", {Q.best_bin('spec', 'best', 1)}" + f"""
select k.key, b.bin, round((b.nfft - 2) / b.bin, 6) as period from {ALL_KEYS}""")
def t6(spark, sf):
    return _dominant(spark, sf, "nodc")


def _slope_sql(on, threshold):
    return SPEC_SQL + f""", {Q.best_bin('spec', 'best', 1)},
fit as (select key, regr_slope(power, {on}) as slope from spec where bin > 0 group by 1)
select f.key, round(f.slope, 6) as slope, cast(abs(f.slope) > {threshold} as int) as seasonal,
  case when abs(f.slope) > {threshold} then round((b.nfft - 2) / b.bin, 6) else 0.0 end as period
from fit f join best b on b.key = f.key"""


@query("T7_seasonal_slope", _slope_sql("(nfft - 2.0) / bin", 0.001))
def t7(spark, sf):
    return S.seasonal_slope(spectrum(spark, sf), "key", 0.001).select(
        "key", F.round("slope", 6).alias("slope"), "seasonal", F.round("period", 6).alias("period"))


@query("T8_seasonal_slope_on_frequency", _slope_sql("1.0 / ((nfft - 2.0) / bin)", 0.01))
def t8(spark, sf):
    return S.seasonal_slope(spectrum(spark, sf), "key", 0.01, on="freq").select(
        "key", F.round("slope", 6).alias("slope"), "seasonal", F.round("period", 6).alias("period"))


def with_period(df):
    """A known period per key, even and odd."""
    return df.withColumn("period", F.when(F.col("key") % 2 == 0, 4.0).otherwise(3.0))


WITH_PERIOD = ", withp as (select key, t, x, case when key % 2 = 0 then 4.0 else 3.0 end as period from series)"


def _season_sql(k, tail=False):
    late = f"(nxt - t) / period >= {k}"
    if tail:
        late = f"coalesce({late}, (n - t) / period >= 2)"
    return SUP + WITH_PERIOD + f""", {Q.extrema('withp', 'ext')},
peaks as (select e.key, e.t, lead(e.t) over (partition by e.key order by e.t) as nxt, p.period, p.n from ext e
  join (select key, any_value(period) as period, count(*) as n from withp group by 1) p on p.key = e.key where e.is_peak)
select key, t from peaks where {late}"""


@query("T9_season_deviation", _season_sql(2))
def t9(spark, sf):
    return N.season_deviation(with_period(supplier_series(spark, sf)), "key").select("key", "t")


@query("T10_season_deviation_tail", _season_sql(1.5, tail=True))
def t10(spark, sf):
    return N.season_deviation(with_period(supplier_series(spark, sf)), "key", k=1.5, tail=True).select("key", "t")


PEAKS_SQL = SUP + WITH_PERIOD + f""", {Q.extrema('withp', 'ext')},
size as (select key, any_value(period) as period, count(*) as n from withp group by 1) """


@query("W17_peak_distance", PEAKS_SQL + """
select key, t, distance from (select key, t, lead(t) over (partition by key order by t) - t as distance from ext where is_peak)
where distance is not null""")
def w17(spark, sf):
    peaks = N.find_peaks(supplier_series(spark, sf), "key")
    gap = F.lead("t").over(W.along("key", "t")) - F.col("t")
    return peaks.withColumn("distance", gap.cast("long")).where(F.col("distance").isNotNull()).select("key", "t", "distance")


@query("W18_tail_distance", PEAKS_SQL + """
select e.key, any_value(s.n) - max(e.t) as points, cast((any_value(s.n) - max(e.t)) / any_value(s.period) >= 2 as int) as is_late
from ext e join size s on s.key = e.key where e.is_peak group by 1""")
def w18(spark, sf):
    marked = N.mark_extrema(with_period(supplier_series(spark, sf)), "key")
    per = marked.groupBy("key", "period").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("is_peak"), F.col("t"))).alias("last"))
    points = F.col("n") - F.col("last")
    return per.where(F.col("last").isNotNull()).select(
        "key", points.alias("points"), (points / F.col("period") >= 2).cast("int").alias("is_late"))


@query("F8_min_max_rescale", SEG + """
select key, t, round((x - lo) / (hi - lo), 8) as scaled from (select *, min(x) over (partition by key) as lo,
  max(x) over (partition by key) as hi from series)""")
def f8(spark, sf):
    lo, hi = F.min("x").over(W.whole("key")), F.max("x").over(W.whole("key"))
    return segment_series(spark, sf).select("key", "t", F.round(rescale(F.col("x"), lo, hi), 8).alias("scaled"))


@query("F9_next_power_of_two", """
select o_custkey, cast(pow(2, ceil(log2(count(*)))) as bigint) as nfft from orders group by 1""")
def f9(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select(
        "o_custkey", next_pow2(F.col("n")).cast("long").alias("nfft"))


@query("F15_reciprocal_with_guard", SPEC_SQL + """
select key, bin, case when bin = 0 then 1000.0 else ceil(round((nfft - 2) / bin, 9)) end as period from spec""")
def f15(spark, sf):
    return spectrum(spark, sf).select(
        "key", F.col("bin").cast("long"), dominant(F.col("bin"), F.col("nfft")).alias("period"))


@query("T11_peaks", CUS + f", {Q.extrema('series', 'ext')} select key, t, x from ext where is_peak")
def t11(spark, sf):
    return N.find_peaks(customer_series(spark, sf), "key").select("key", "t", "x")


@query("T12_troughs", CUS + f", {Q.extrema('series', 'ext')} select key, t, x from ext where is_trough")
def t12(spark, sf):
    return N.find_peaks(customer_series(spark, sf), "key", sign=-1).select("key", "t", "x")


@query("T13_extrema", SUP + f""", {Q.extrema('series', 'ext')}
select key, t, x, row_number() over (partition by key order by t) - 1 as ordinal from ext where is_peak or is_trough""")
def t13(spark, sf):
    return N.extrema(supplier_series(spark, sf), "key").select("key", "t", "x", F.col("ordinal").cast("long"))


def thousandths(value: str) -> str:
    return f"cast(round(cast({value} as decimal(38,6)), 3) as double)"


@query("T14_decomposition", SEG + WITH_PERIOD + f""", {Q.trend('withp', 'tr')},
ph as (select m.*, p.p, m.t % p.p as phase from tr_m m join (select key, any_value(p) as p from tr_p group by 1) p on p.key = m.key),
av as (select key, phase, avg(x - raw) as m from ph group by 1, 2),
ce as (select key, phase, m - avg(m) over (partition by key) as seasonal from av)
select ph.key, ph.t, coalesce({thousandths('raw')}, -1) as trend, {thousandths('seasonal')} as seasonal,
  coalesce({thousandths('x - raw - seasonal')}, -1) as resid from ph join ce on ce.key = ph.key and ce.phase = ph.phase""")
def t14(spark, sf):
    out = N.decompose(with_period(segment_series(spark, sf)), "key")
    # exact halves are frequent here: six places are free of the noise that decides how a half is rounded
    exact = lambda c: F.round(F.col(c).cast("decimal(38,6)"), 3).cast("double")
    missing = lambda c: F.coalesce(exact(c), F.lit(-1.0)).alias(c)
    return out.select("key", "t", missing("trend"), exact("seasonal").alias("seasonal"), missing("resid"))


@query("T15_trend_deviation", SUP + WITH_PERIOD + f", {Q.trend('withp', 'tr')} select key, t, type, round(ratio, 4) as ratio from ({Q.deviations('tr', 1.5)})")
def t15(spark, sf):
    return N.trend_deviation(with_period(supplier_series(spark, sf)), "key").select(
        "key", "t", "type", F.round("ratio", 4).alias("ratio"))


@query("T16_amplitude_deviation", SUP + WITH_PERIOD + f""", {Q.extrema('withp', 'ext')},
points as (select key, t as pos, row_number() over (partition by key order by t) - 1 as t, x,
  case when key % 2 = 0 then 4.0 else 3.0 end as period from ext where is_peak or is_trough),
{Q.trend('points', 'amp')}, amp_at as (select a.*, q.pos from amp a join points q on q.key = a.key and q.t = a.t)
select key, t, type, round(ratio, 4) as ratio from ({Q.deviations('amp_at', 1.5, 'amp_', 'pos')})""")
def t16(spark, sf):
    return N.amplitude_deviation(with_period(supplier_series(spark, sf)), "key").select(
        "key", "t", "type", F.round("ratio", 4).alias("ratio"))


@query("T17_zero_points", CUS + " select key, t, 'zero' as type from series where x < 10")
def t17(spark, sf):
    return N.find_zeros(customer_series(spark, sf), "key").select("key", "t", "type")


FLAGS_SQL = CUS + """, flags as (select key, t, case when x < 10 then 'zero' when x > 120000 then 'increase' else 'decrease' end as type,
  0.0 as ratio from series where x < 10 or x > 120000 or x between 20000 and 80000)"""


def _flags(spark, sf):
    x = F.col("x")
    kind = F.when(x < 10, "zero").when(x > 120000, "increase").otherwise("decrease")
    return customer_series(spark, sf).where((x < 10) | (x > 120000) | x.between(20000, 80000)).select(
        "key", "t", kind.alias("type"), F.lit(0.0).alias("ratio"))


@query("T18_collapse_runs", FLAGS_SQL + f" select key, idx as t, type from ({Q.collapsed('flags')})")
def t18(spark, sf):
    return N.collapse_runs(_flags(spark, sf), "key").select("key", "t", "type")


BY = "partition by key order by t"


@query("T19_collapse_adjacent", FLAGS_SQL + f""",
a as (select *, sum(case when type is distinct from prev then 1 else 0 end) over ({BY} rows unbounded preceding) as run
  from (select *, lag(type) over ({BY}) as prev from flags)),
b as (select key, t, case when type = 'zero' and count(*) over (partition by key, run) > 2 then 'offline' else type end as type from a),
c as (select key, t, type from b qualify lag(type) over ({BY}) is null or lag(type) over ({BY}) <> type)
select key, t, type from c
qualify not (count(*) over (partition by key) > 2 and row_number() over (partition by key order by t desc) = 1
  and coalesce(lag(type) over ({BY}), '') = 'offline')""")
def t19(spark, sf):
    return N.collapse_runs(_flags(spark, sf), "key", mode="adjacent").select("key", "t", "type")


@query("T20_collapse_without_relabel", FLAGS_SQL + """
select key, min(t) as t, type from (select *, t - row_number() over (partition by key, type order by t) as island from flags)
group by key, type, island""")
def t20(spark, sf):
    return N.collapse_runs(_flags(spark, sf), "key", relabel=False).select("key", "t", "type")


LOWESS_SQL = SUP + WITH_PERIOD + f""", {Q.trend('withp', 'tr')}, {Q.lowess('tr', 'fit', 'coalesce(trend, x)')},
off as (select tr.key, tr.t, tr.x, coalesce(tr.trend, tr.x) as trend, fit.smooth from tr join fit on fit.key = tr.key and fit.t = tr.t)"""


@query("T21_lowess_deviation", LOWESS_SQL + """
select key, t, round(smooth, 2) as smooth,
  cast(coalesce(abs(smooth - trend) / nullif(max(abs(smooth - trend)) over (partition by key), 0), 0) > 0.8 as int) as flag from off""")
def t21(spark, sf):
    return G.lowess_deviation(with_period(supplier_series(spark, sf)), "key").select(
        "key", "t", F.round("smooth", 2).alias("smooth"), "flag")


@query("T22_lowess_against_signal", LOWESS_SQL + """,
scored as (select *, coalesce(abs(smooth - x) / nullif(stddev_pop(abs(smooth - x)) over (partition by key), 0), 0) as score from off)
select key, t, round(score, 4) as score, cast(score > 1.25 as int) as flag from scored""")
def t22(spark, sf):
    return G.lowess_deviation(with_period(supplier_series(spark, sf)), "key", threshold=1.25, against="signal").select(
        "key", "t", F.round("score", 4).alias("score"), "flag")


ACF_SQL = SUP + """, c as (select key, t, x - avg(x) over (partition by key) as c, count(*) over (partition by key) as n from series),
r as (select a.key, a.lag, any_value(a.n) as n, sum(a.c * b.c) as num
  from (select *, unnest(range(0, n)) as lag from c) a join c b on b.key = a.key and b.t = a.t + a.lag group by 1, 2),
f as (select key, lag, n, num / max(num) filter (lag = 0) over (partition by key) as r from r),
s as (select *, case when lag = 0 then 0 else sqrt((1 + 2 * coalesce(sum(case when lag > 0 then r * r end) over (partition by key order by lag
  rows between unbounded preceding and 1 preceding), 0)) / n) end as se from f)"""


def acf_rows(spark, sf):
    return S.acf(supplier_series(spark, sf), "key")


@query("T23_autocorrelation", ACF_SQL + """
select key, lag, round(r, 6) as r, round(se, 6) as se, cast(lag > 0 and abs(r) > 1.959963984540054 * se as int) as significant from s""")
def t23(spark, sf):
    return acf_rows(spark, sf).select(
        "key", F.col("lag").cast("long"), F.round("r", 6).alias("r"), F.round("se", 6).alias("se"), "significant")


@query("T23_autocorrelation_flag", ACF_SQL + """
select key, count(*) filter (lag > 0 and abs(r) > 1.959963984540054 * se) as lags,
  cast(count(*) filter (lag > 0 and abs(r) > 1.959963984540054 * se) > 0 as int) as flag from s group by 1""")
def t23_flag(spark, sf):
    return S.acf_flag(acf_rows(spark, sf), "key").select("key", "lags", "flag")


@query("T24_partial_autocorrelation", ACF_SQL.replace("with ", "with recursive ", 1) + """,
lists as (select key, list(r order by lag) as r from f group by key),
durbin as (
  select key, r, 0 as lag, 1.0::double as pacf, 1.0::double as err, cast([] as double[]) as phi from lists
  union all
  select key, r, lag + 1, last, err * (1 - last * last),
    list_append(list_transform(list_zip(phi, list_reverse(phi)), lambda z: z[1] - last * z[2]), last)
  from (select *, (r[lag + 2] - coalesce(list_inner_product(phi, list_reverse(r[2:lag + 1])), 0)) / err as last from durbin where lag + 1 < len(r)))
select key, cast(lag as bigint) as lag, round(pacf, 6) as pacf from durbin""")
def t24(spark, sf):
    return G.pacf(acf_rows(spark, sf), "key").select("key", "lag", F.round("pacf", 6).alias("pacf"))


# the regressors are taken out one after another; what is left of the squares gives the criterion of every number of lags at once
UNIT_ROOT_SQL = SUP.replace("with ", "with recursive ", 1) + f""",
gone as (select key, t, x - lag(x, 1) over w - lag(x, 12) over w + lag(x, 13) over w as z from series window w as (partition by key order by t)),
lists as (select key, list(z order by t) as x, count(*) as len, greatest(0, count(*) // 2 - 3) as top from gone where z is not null group by key),
steps as (select key, x, top, list_transform(list_zip(x[2:], x[1:len - 1]), lambda v: v[1] - v[2]) as dx, len - 1 as m from lists),
full_design as (select key, m - top as n, dx[top + 1:] as y, list_concat([list_transform(dx[top + 1:], lambda v: 1.0::double), x[top + 1:m]],
  list_transform(range(1, top + 1), lambda k: dx[top + 1 - k:m - k])) as cols from steps),
{Q.partial_out('full_design', 'tried')},
chosen as (select key, arg_min(step - 2, (n * ln(ss / n) + 2 * step, step)) as lags from tried where step >= 2 and n > step + 1 group by key),
own_design as (select key, m - lags as n, dx[lags + 1:] as y, list_concat([list_transform(dx[lags + 1:], lambda v: 1.0::double)],
  list_transform(range(1, lags + 1), lambda k: dx[lags + 1 - k:m - k]), [x[lags + 1:m]]) as cols from steps join chosen using (key)),
{Q.partial_out('own_design', 'taken')},
stats as (select key, n, lags, qy / sqrt(qq) / sqrt(ss / (n - lags - 2)) as s from taken join chosen using (key) where step = lags + 2),
placed as (select *, case when s <= -1.61 then 2.1659 + 1.4412 * s + 0.038269 * s * s
  else 1.7339 + 0.93202 * s - 0.12745 * s * s - 0.010368 * s * s * s end / sqrt(2) as z from stats),
normal as (select key, sum(case when k % 2 = 0 then 1 else -1 end * exp((2 * k + 1) * ln(abs(z)) - lgamma(k + 1)) / (2 * k + 1)) * sign(any_value(z)) as part
  from placed, (select unnest(range(0, 120)) as k) where abs(z) > 0 group by key)
select key, n as n_obs, cast(lags as int) as lags, round(s, 4) as statistic,
  round(case when s < -18.83 then 0 when s > 2.74 then 1 else 0.5 * (1 + 2 / sqrt(pi()) * coalesce(part, 0)) end, 6) as p_value,
  round(-2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n), 4) as crit_5,
  cast(s < -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n) as int) as stationary
from placed left join normal using (key)"""


@query("T25_unit_root", UNIT_ROOT_SQL)
def t25(spark, sf):
    diffed = W.difference(supplier_series(spark, sf), "key", "t", "x", d=1, seasonal_d=1, s=12)
    return G.adf(diffed, "key", "t", "diff").select(
        "key", "n_obs", "lags", F.round("statistic", 4).alias("statistic"), F.round("p_value", 6).alias("p_value"),
        F.round("crit_5", 4).alias("crit_5"), "stationary")


@query("T26_ks_uniform", SPEC_SQL + f""", {Q.best_bin('spec', 'best')},
d as (select key, max(greatest(i / n - power, power - (i - 1) / n)) as distance, max(n) as n from (
  select key, power, cast(row_number() over (partition by key order by power) as double) as i,
    cast(count(*) over (partition by key) as double) as n from spec) group by 1),
p as (select key, any_value(distance) as distance, any_value(n) as n,
  greatest(0.0, least(1.0, case when any_value(distance) * sqrt(any_value(n)) < 0.2 then 1.0
    else sum(case when k % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * k * k * distance * distance * n)) end)) as p
  from d cross join (select unnest(range(1, 101)) as k) group by key)
select p.key, round(p.distance, 6) as distance, round(p.p, 6) as p_value, b.bin, cast(p.p < 0.05 and b.bin <> 0 as int) as seasonal
from p join best b on b.key = p.key""")
def t26(spark, sf):
    return S.ks_uniform(spectrum(spark, sf), "key").select(
        "key", F.round("distance", 6).alias("distance"), F.round("p_value", 6).alias("p_value"),
        F.col("bin").cast("long"), "seasonal")


AR_LAGS, MA_LAGS = G.product_lags(2, 1, 12), G.product_lags(1, 1, 12)
LONG = max(AR_LAGS + MA_LAGS)
DEEP = LONG + max(MA_LAGS)


def _with_units(cols: str, n: str, k: int) -> str:
    """Columns, each with a unit vector of its own behind it."""
    return f"list_transform({cols}, lambda c, i: list_concat(c, list_transform(range(1, {k + 1}), lambda j: case when i = j then 1.0::double else 0.0::double end)))"


def _regressors(lags, source: str, start: int) -> str:
    return ", ".join(f"{source}[{start - k + 1}:len - {k}]" for k in lags)


def _zeros(k: int) -> str:
    return "[" + ", ".join(["0.0::double"] * k) + "]"


def _ones(start: int) -> str:
    return f"list_transform(z[{start + 1}:], lambda v: 1.0::double)"


ROWS = len(AR_LAGS) + len(MA_LAGS) + 1
ROUNDS = 12
PAST = " + ".join([f"c[{i + 1}] * zs[len(zs) - {k - 1}]" for i, k in enumerate(AR_LAGS)]
                  + [f"c[{len(AR_LAGS) + i + 1}] * es[len(es) - {k - 1}]" for i, k in enumerate(MA_LAGS)])
FORECAST_SQL = SUP.replace("with ", "with recursive ", 1) + f""",
gone as (select key, t, x - lag(x, 1) over w - lag(x, 12) over w + lag(x, 13) over w as z from series window w as (partition by key order by t)),
lists as (select key, list(z order by t) filter (z is not null) as z, count(z) as len, list(s.x order by t) as xs, max(t) as last_t
  from gone join series s using (key, t) group by key),
long_design as (select key, len - {LONG} as n, list_concat(z[{LONG + 1}:], {_zeros(LONG + 1)}) as y,
  {_with_units(f"[{_regressors(range(1, LONG + 1), 'z', LONG)}, {_ones(LONG)}]", 'n', LONG + 1)} as cols from lists),
{Q.partial_out('long_design', 'long_fit')},
noisy as (select l.*, list_concat({_zeros(LONG)}, f.y[1:f.n]) as e from lists l join long_fit f on f.key = l.key and f.step = {LONG + 1}),
design as (select key, len - {DEEP} as n, list_concat(z[{DEEP + 1}:], {_zeros(ROWS)}) as y,
  {_with_units(f"[{_regressors(AR_LAGS, 'z', DEEP)}, {_regressors(MA_LAGS, 'e', DEEP)}, {_ones(DEEP)}]", 'n', ROWS)} as cols from noisy),
{Q.partial_out('design', 'model')},
solved as (select o.*, list_transform(m.y[m.n + 1:], lambda v: -v) as c, m.y[1:m.n] as resid from noisy o join model m on m.key = o.key and m.step = {ROWS}),
ahead as (
  select key, 0 as h, c, z as zs, e as es, xs, last_t from solved
  union all
  select key, h + 1, c, list_append(zs, step), list_append(es, 0.0::double), list_append(xs, step + xs[len(xs)] + xs[len(xs) - 11] - xs[len(xs) - 12]), last_t
  from (select *, c[{ROWS}] + {PAST} as step from ahead where h < {ROUNDS})),
fitted as (select key, last_t - len(resid) + i as t, xs[len(xs) - len(resid) + i] - resid[i] as value from (select *, unnest(range(1, len(resid) + 1)) as i from solved)),
future as (select key, last_t + i as t, xs[len(xs) - {ROUNDS} + i] as value, i from (select *, unnest(range(1, {ROUNDS + 1})) as i from ahead where h = {ROUNDS})),
ends as (select f.key, f.value as last_fit, u.value as first from fitted f join future u on u.key = f.key and u.i = 1 and f.t = u.t - 1)"""


@query("T27_seasonal_forecast", FORECAST_SQL + """
select key, t, 'fitted' as kind, round(value) as value, 'ok' as status from fitted
union all select key, t, 'forecast', round(value), 'ok' from future
union all select key, t, 'joined', round(value - first + last_fit), 'ok' from future join ends using (key)""")
def t27(spark, sf):
    out = G.seasonal_forecast(supplier_series(spark, sf), "key", s=12, h=12, q=1, seasonal_q=1)
    return out.select("key", "t", "kind", F.round("value").alias("value"), "status")


@query("T28_spectral_peaks", SPEC_SQL + """
select key, count(*) filter (power >= m) as peaks from (
  select key, power, avg(power) over (partition by key) + 2 * stddev_pop(power) over (partition by key) as m from spec) group by 1""")
def t28(spark, sf):
    return S.spectral_peaks(spectrum(spark, sf), "key")


@query("T29_spectral_cv", SPEC_SQL + " select key, round(stddev_pop(power) / avg(power), 6) as cv from spec group by 1")
def t29(spark, sf):
    return S.spectral_cv(spectrum(spark, sf), "key").select("key", F.round("cv", 6).alias("cv"))


@query("T30_ols", SUP + " select key, round(regr_slope(x, t), 4) as slope, round(regr_intercept(x, t), 2) as intercept from series group by 1")
def t30(spark, sf):
    return S.ols(supplier_series(spark, sf), "key", "t", "x").select(
        "key", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("T31_peak_amplitudes", SUP + f""", {Q.extrema('series', 'ext')},
p as (select key, t, x as amplitude, row_number() over (partition by key order by t) - 1 as ordinal from ext where is_peak)
select key, ordinal, t, amplitude, round(sum(amplitude) over (partition by key order by ordinal rows between 1 preceding and 1 following) / 3.0, 4) as smooth from p""")
def t31(spark, sf):
    return N.peak_amplitudes(supplier_series(spark, sf), "key").select(
        "key", F.col("ordinal").cast("long"), "t", "amplitude", F.round("smooth", 4).alias("smooth"))


@query("L5_reversed_series", SEG + """
select key, array_to_string(list(cast(floor(x) as bigint) order by t desc), ',') as backwards from series group by 1""")
def l5(spark, sf):
    arrays = S.series_arrays(segment_series(spark, sf), "key")
    text = F.transform(F.reverse("xs"), lambda v: F.floor(v).cast("string"))
    return arrays.select("key", F.array_join(text, ",").alias("backwards"))


@query("U3_peaks_and_troughs", CUS + f", {Q.extrema('series', 'ext')} select key, t, case when is_peak then 'peak' else 'trough' end as kind from ext where is_peak or is_trough")
def u3(spark, sf):
    marked = N.mark_extrema(customer_series(spark, sf), "key", "t", "x").where(F.col("is_peak") | F.col("is_trough"))
    return marked.select("key", "t", F.when(F.col("is_peak"), "peak").otherwise("trough").alias("kind")).orderBy("key", "t")
