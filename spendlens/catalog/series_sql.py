"""Checking SQL for the series operators, built from self-joins and plain windows.

Each function returns common table expressions; the formulation differs from the Spark
plans on purpose (explicit Fourier sums, joins on index distance).
"""

POWER_DIGITS = 9


def detrended(src: str, out: str, w: int = 4) -> str:
    """(key, t, d): value minus the centred mean over min(w, n) points."""
    return f"""{out}_n as (select *, count(*) over (partition by key) as n, least({w}, count(*) over (partition by key)) as w from {src}),
{out} as (select a.key, a.t, any_value(a.n) as n, any_value(a.x) - sum(b.x) / any_value(a.w) as d
  from {out}_n a join {out}_n b on a.key = b.key and b.t between a.t - a.w // 2 and a.t + (a.w - 1) // 2
  group by a.key, a.t)"""


def spectrum(src: str, out: str) -> str:
    """(key, n, nfft, bin, power) of (key, t, n, d): bins below nfft/2, rescaled to 0..1."""
    return f"""{out}_z as (select *, cast(pow(2, ceil(log2(n))) as bigint) as nfft from {src}),
{out}_e as (select key, any_value(n) as n, any_value(nfft) as nfft, sum(d * d) as energy from {out}_z group by key),
{out}_b as (select e.*, unnest(range(0, nfft // 2 + 1)) as bin from {out}_e e),
{out}_p as (select b.key, b.bin, any_value(b.n) as n, any_value(b.nfft) as nfft, any_value(b.energy) as energy,
    pow(sum(z.d * cos(2 * pi() * ((z.t * b.bin) % b.nfft) / b.nfft)), 2)
    + pow(sum(z.d * sin(2 * pi() * ((z.t * b.bin) % b.nfft) / b.nfft)), 2) as p
  from {out}_b b join {out}_z z on z.key = b.key group by b.key, b.bin),
{out}_r as (select *, min(p) over (partition by key) as lo, max(p) over (partition by key) as hi from {out}_p),
{out} as (select key, n, nfft, bin, (p - lo) / (hi - lo) as power from {out}_r
  where bin < nfft // 2 and hi - lo > 1e-12 * greatest(1.0, energy * n))"""


def best_bin(src: str, out: str, first: int = 0) -> str:
    """(key, nfft, bin): strongest bin from ``first`` on, the lowest among equals."""
    return f"""{out} as (select key, nfft, bin, power from {src} where bin >= {first}
  qualify row_number() over (partition by key order by round(power, {POWER_DIGITS}) desc, bin) = 1)"""


def period_ceil(b: str = "b") -> str:
    return f"case when coalesce({b}.bin, 0) = 0 then 1000.0 else ceil(round(({b}.nfft - 2) / {b}.bin, 9)) end"


def extrema(src: str, out: str) -> str:
    """(key, t, x, is_peak, is_trough) at the middles of plateaus."""
    return f"""{out}_c as (select *, case when x is distinct from lag(x) over (partition by key order by t) then 1 else 0 end as chg from {src}),
{out}_g as (select *, sum(chg) over (partition by key order by t rows unbounded preceding) as run from {out}_c),
{out}_u as (select key, run, (min(t) + max(t)) // 2 as t, any_value(x) as x from {out}_g group by key, run),
{out} as (select key, t, x, coalesce(x > a and x > b, false) as is_peak, coalesce(x < a and x < b, false) as is_trough
  from (select *, lag(x) over (partition by key order by run) as a, lead(x) over (partition by key order by run) as b from {out}_u))"""


def trend(src: str, out: str, w: int = 4) -> str:
    """(key, t, x, n, trend, deviation, rolling_std) of (key, t, x, period)."""
    return f"""{out}_n as (select *, count(*) over (partition by key) as n from {src}),
{out}_p as (select *, cast(case when n <= period then n - 1 else period end as bigint) as p from {out}_n),
{out}_m as (select a.key, a.t, any_value(a.x) as x, any_value(a.n) as n,
    case when any_value(a.p) > 0 and count(*) = 2 * (any_value(a.p) // 2) + 1
      then sum(b.x * case when a.p % 2 = 0 and abs(a.t - b.t) = a.p // 2 then 0.5 else 1.0 end) / any_value(a.p) end as raw
  from {out}_p a join {out}_p b on a.key = b.key and abs(a.t - b.t) <= a.p // 2 group by a.key, a.t),
{out}_f as (select *, coalesce(raw, case when t < min(t) filter (raw is not null) over (partition by key)
    then arg_min(raw, t) filter (raw is not null) over (partition by key)
    else arg_max(raw, t) filter (raw is not null) over (partition by key) end) as trend from {out}_m),
{out}_d as (select *, x - trend as deviation from {out}_f),
{out}_s as (select *, case when count(deviation) over k >= least({w}, n) then stddev_samp(deviation) over k end as sd
  from {out}_d window k as (partition by key order by t rows between {w - 1} preceding and current row)),
{out} as (select *, coalesce(sd, avg(sd) over (partition by key)) as rolling_std from {out}_s)"""


def deviations(src: str, threshold: float, prefix: str = "", idx: str = "t") -> str:
    """select (key, t, type, ratio) of the points off the trend."""
    return f"""select key, {idx} as t, case when deviation < 0 then '{prefix}decrease' else '{prefix}increase' end as type,
  case when rolling_std = 0 then 'Infinity'::double else abs(deviation / rolling_std) end as ratio
from {src} where n >= 2 and abs(deviation) > {threshold} * abs(rolling_std)"""


def trimmed(src: str) -> str:
    """(body: key, idx as t, x) without leading zeros and (core) also without trailing zeros."""
    return f"""lead_cut as (select *, min(t) filter (x <> 0) over (partition by key) as t0,
  max(t) filter (x <> 0) over (partition by key) as t1 from {src}),
body as (select key, t - coalesce(t0, 0) as t, x, coalesce(t1, 100000) - coalesce(t0, 0) as stop from lead_cut where t >= coalesce(t0, 0)),
core as (select key, t, x from body where t <= stop)"""


def collapsed(src: str) -> str:
    """select of the first flag of every run, zeros in a row being offline."""
    return f"""select key, min(t) as idx, case when type = 'zero' and count(*) >= 2 then 'offline' else type end as type,
  arg_min(ratio, t) as ratio
from (select *, t - row_number() over (partition by key, type order by t) as island from {src}) group by key, type, island"""


def whole_detector(series_cte: str, threshold: float = 1.5) -> str:
    """Everything: periods, four rules, one type per point, runs collapsed."""
    return f"""with {series_cte}, {trimmed('series')},
{detrended('core', 'det')}, {spectrum('det', 'spec')}, {best_bin('spec', 'best')},
periods as (select k.key, {period_ceil('b')} as period from (select distinct key from body) k left join best b on b.key = k.key),
withp as (select s.key, s.t, s.x, p.period from body s join periods p on p.key = s.key),
{extrema('withp', 'ext')}, {trend('withp', 'tr')},
points as (select e.key, e.t as pos, row_number() over (partition by e.key order by e.t) - 1 as t, e.x, p.period,
  count(*) over (partition by e.key) as points from ext e join periods p on p.key = e.key where e.is_peak or e.is_trough),
{trend('points', 'amp')},
amp_at as (select a.*, q.pos from amp a join points q on q.key = a.key and q.t = a.t),
peaks as (select e.key, e.t, lead(e.t) over (partition by e.key order by e.t) as nxt, p.period
  from ext e join periods p on p.key = e.key where e.is_peak),
flags as ({deviations('tr', threshold)}
  union all {deviations('amp_at', threshold, 'amp_', 'pos')}
  union all select key, t, 'season', 0.0 from peaks where (nxt - t) / period >= 2
  union all select key, t, 'zero', 0.0 from body where x < 10),
final as (select key, t, type, ratio from flags qualify row_number() over (partition by key, t order by type desc) = 1),
runs as ({collapsed('final')})
"""


def lowess(src: str, out: str, value: str = "trend", frac: float = 0.75, passes: int = 3) -> str:
    """(key, t, smooth) of (key, t, value): every local line as plain weighted sums over its window, once more per pass."""
    text = f"""{out}_s as (select key, t, {value} as y, count(*) over (partition by key) as n,
  cast(least(count(*) over (partition by key), greatest(2, floor({frac} * count(*) over (partition by key) + 1e-10))) as bigint) as near from {src}),
{out}_w as (select *, greatest(0, least(t - (near - 1) // 2, n - near)) as lo from {out}_s),
{out}_v as (select *, greatest(t - lo, lo + near - 1 - t, 1) as reach from {out}_w),
{out}_k as (select a.key, a.t, a.y as here, b.t as u, b.y, cast(abs(b.t - a.t) as double) / a.reach as share
  from {out}_v a join {out}_v b on b.key = a.key and b.t >= a.lo and b.t < a.lo + a.near),
{out}_t as (select *, case when share <= 0.001 then 1.0 when share < 0.999 then pow(1 - pow(share, 3), 3) else 0.0 end as tri from {out}_k),
{out}_r0 as (select key, t, 1.0::double as robust from {out}_s)"""
    for i in range(passes + 1):
        text += f""",
{out}_m{i} as (select w.key, w.t, any_value(here) as here, sum(tri * robust) as s0, sum(tri * robust * (u - w.t)) as s1, sum(tri * robust * pow(u - w.t, 2)) as s2,
    sum(tri * robust * y) as y0, sum(tri * robust * y * (u - w.t)) as y1 from {out}_t w join {out}_r{i} r on r.key = w.key and r.t = w.u group by 1, 2),
{out}_f{i} as (select key, t, here, case when s0 <= 1e-12 then here when s2 / s0 - pow(s1 / s0, 2) <= 1e-12 then y0 / s0
    else (s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1) end as smooth from {out}_m{i}),
{out}_c{i} as (select *, 6 * median(abs(here - smooth)) over (partition by key) as scale, greatest(1.0, max(abs(here)) over (partition by key)) as size from {out}_f{i}),
{out}_r{i + 1} as (select c.key, c.t, case when scale <= 1e-12 * size then r.robust when abs(here - smooth) / scale <= 0.001 then 1.0
    when abs(here - smooth) / scale < 0.999 then pow(1 - pow(abs(here - smooth) / scale, 2), 2) else 0.0 end as robust
  from {out}_c{i} c join {out}_r{i} r on r.key = c.key and r.t = c.t)"""
    return text + f""",
{out} as (select key, t, smooth from {out}_f{passes})"""


def partial_out(src: str, out: str) -> str:
    """Recursion (key, step, n, cols, y, ss, qy, qq) over (key, n, cols, y): one column after another is taken out of those behind it
    and out of y. Only the first n entries of a column are data; what is appended to them goes along, so that unit vectors behind the
    columns collect the coefficients (negative) behind y."""
    dot = lambda a, b: f"list_inner_product({a}[1:n], {b}[1:n])"
    minus = lambda a, f: f"list_transform(list_zip({a}, cols[1]), lambda z: z[1] - ({f}) * z[2])"
    return f"""{out} as (
  select key, 0 as step, n, cols, y, {dot('y', 'y')} as ss, 0.0::double as qy, 0.0::double as qq from {src}
  union all
  select key, step + 1, n, list_transform(held, lambda c: list_transform(list_zip(c.v, q), lambda z: z[1] - c.f * z[2])), rest, {dot('rest', 'rest')}, qy1, qq1 from (
    select key, step, n, cols[1] as q, {dot('cols[1]', 'cols[1]')} as qq1, {dot('y', 'cols[1]')} as qy1,
      list_transform(cols[2:], lambda c: {{'v': c, 'f': {dot('c', 'cols[1]')} / {dot('cols[1]', 'cols[1]')}}}) as held,
      {minus('y', f"{dot('y', 'cols[1]')} / {dot('cols[1]', 'cols[1]')}")} as rest
    from {out} where len(cols) > 0))"""
