"""SQL of the feature frame, the data set, walk-forward folds and what is measured over them."""

from __future__ import annotations

from marlstone.plans.oracle import SQL as BASE
from marlstone.plans.oracle import _clip, _roll, _sql

_W = "window w as (partition by symbol order by date)"
UNIQUENESS = BASE["uniqueness_weights"]
TABLES = "bars bench market_regime sector_index delivery sessions sector_of"


def _mean(x: str, alpha: str, adjust: bool, least: int = 1) -> str:
    """Weighted mean of x, which is never null, over the rows n = 1, 2, ... of a symbol."""
    q, run = f"(1-({alpha}))", "over (partition by symbol order by date rows between unbounded preceding and current row)"
    total = f"({alpha})*sum({x}*pow({q},-n)) {run}*pow({q},n)"
    return f"case when n>={least} then {total}/(1-pow({q},n)) end" if adjust else f"({total}+pow({q},n)*first_value({x}) {run})"


INTRADAY = f"""
i0 as (select symbol, date, arg_min(open, minute) o, max(high) h, min(low) lo, arg_max(close, minute) c, max(close) filter (minute=855) c14, max(close) filter (minute=915) c15,
 sum((high+low+close)/3*volume::double) pv, sum(volume::double) v, max(volume::double) vm, sum(volume::double) filter (minute in (555,570)) ov, sum(volume::double) filter (minute=915) cv from sessions group by symbol, date),
t0 as (select symbol, date, greatest(high-low, abs(high-lag(close) over w), abs(low-lag(close) over w)) tr, row_number() over w n from bars {_W}),
t1 as (select symbol, date, case when n>=14 then {_mean('tr', '1/14.0::double', False)} end atr from t0),
i1 as (select i.symbol, i.date, (o-lag(c) over w)/lag(c) over w as overnight_gap, (h-lo)/nullif(atr,0) as intraday_range_ratio, (c15-c14)/c14 as last_hour_momentum, (c-pv/v)/(pv/v) as vwap_deviation, vm/v as vol_concentration from i0 i left join t1 using (symbol, date) {_W}),
i2 as (select symbol, date, ov/nullif(case when count(ov) over f>=5 then avg(ov) over f end,0) x from i0 where ov is not null window f as (partition by symbol order by date rows between 20 preceding and 1 preceding)),
i3 as (select symbol, date, cv/nullif(case when count(cv) over f>=5 then avg(cv) over f end,0) x from i0 where cv is not null window f as (partition by symbol order by date rows between 20 preceding and 1 preceding)),
intra as (select i1.*, least(greatest(i2.x,0),10) as opening_drive_vol, least(greatest(i3.x,0),10) as closing_spike_vol from i1 join i2 using (symbol, date) join i3 using (symbol, date)
 where overnight_gap is not null and intraday_range_ratio is not null and last_hour_momentum is not null and vwap_deviation is not null and vol_concentration is not null and i2.x is not null and i3.x is not null)"""

_PCT = "(select a.date, case when count(b.{x})>=30 and max(a.{x}) is not null then (count(*) filter (b.{x}<a.{x})+(count(*) filter (b.{x}=a.{x})+1)/2.0::double)/count(b.{x}) end p from g a join g b on b.i between a.i-251 and a.i group by a.date)"

MARKET = f"""
g as (select date, vix, case when count(*) over (order by date rows 9 preceding)>=10 then sum(flow) over (order by date rows 9 preceding) end flow10, row_number() over (order by date) i from market_regime),
rg as (select g.date, 1-2*pv.p vix_score, 2*pf.p-1 flow_score from g left join {_PCT.format(x='vix')} pv on pv.date=g.date left join {_PCT.format(x='flow10')} pf on pf.date=g.date),
m0 as (select 'bench' symbol, date, close from bench),
tr0 as (select date, close, {_roll('avg', 'close', 50, 30)} a, {_roll('avg', 'close', 200, 100)} b from m0),
trend as (select date, coalesce({_clip('(close-a)/a*10', -1.0, 1.0)},0.0)*0.5+coalesce({_clip('(close-b)/b*10', -1.0, 1.0)},0.0)*0.5 x from tr0),
k1 as (select date, close/lag(close) over (order by date)-1 r, row_number() over (order by date) i from bench),
k2 as (select date, i, case when r>0.005 then 1 when r< -0.005 then -1 when r is not null then 0 end s from k1),
k3 as (select date, i, s, lag(s) over (order by date) p from k2),
markov as (select date, case when nstates>=60 then coalesce(u/n,0.0) else 0.0 end x from (select a.date, count(b.s) filter (b.i>=a.i-60) nstates, sum(b.s) filter (b.i>=a.i-59 and b.p=l.s) u, nullif(count(*) filter (b.i>=a.i-59 and b.p=l.s),0)::double n from k3 a left join k3 b on b.i between a.i-60 and a.i-1 left join k3 l on l.i=a.i-1 group by a.date)),
sr as (select s.sector, s.date, coalesce({_clip('(s.r-b.r)/0.2', -1.0, 1.0)},0.0) x from (select index_name sector, date, close/lag(close,20) over (partition by index_name order by date)-1 r from sector_index) s join (select date, close/lag(close,20) over (order by date)-1 r from bench) b on s.date=b.date),
dl as (select symbol, date, (delivery_pct-{_roll('avg', 'delivery_pct', 60, 10)})/(case when {_roll('stddev_samp', 'delivery_pct', 60, 10)}=0 then 1.0 else {_roll('stddev_samp', 'delivery_pct', 60, 10)} end) z from delivery)"""

FRAME = f"""{INTRADAY}, {MARKET},
p0 as (select b.symbol, b.date, b.close, b.volume::double volume, m.close bench_close, o.sector, r.vix_score, r.flow_score, t.x trend, k.x markov, s.x sector_rotation, case when dl.z is not null then greatest(-3.0,least(3.0,dl.z))/3 end delivery
 from bars b asof left join bench m on b.date>=m.date left join sector_of o on o.symbol=b.symbol asof left join rg r on b.date>=r.date asof left join trend t on b.date>=t.date asof left join markov k on b.date>=k.date
 asof left join sr s on s.sector=o.sector and b.date>=s.date left join dl on dl.symbol=b.symbol and dl.date=b.date),
p1 as (select *, coalesce(greatest(close-lag(close) over w,0),0.0) gain, coalesce(greatest(lag(close) over w-close,0),0.0) loss, row_number() over w n, close/lag(close) over w-1 r, close/lag(close,5) over w-1 r5,
 0.2*(close/lag(close,21) over w-1)+0.4*(close/lag(close,63) over w-1)+0.4*(close/lag(close,126) over w-1) mo, (close/lag(close,63) over w-1)-(bench_close/lag(bench_close,63) over w-1) rs from p0 {_W}),
p2 as (select *, {_mean('gain', '1/14.0::double', True, 14)} ag, {_mean('loss', '1/14.0::double', True, 14)} al, {_mean('close', '2/13.0::double', False)}-{_mean('close', '2/27.0::double', False)} ml,
 {_roll('avg', 'close', 20)} a20, {_roll('avg', 'close', 50)} a50, {_roll('stddev_samp', 'close', 20)} d20, volume/{_roll('avg', 'volume', 20)} v, {_roll('stddev_samp', 'r', 20)} s20, {_roll('stddev_samp', 'r', 60)} s60 from p1),
p3 as (select *, ml-{_mean('ml', '2/10.0::double', False)} h from p2),
p4 as (select *, lag(h) over w hp from p3 {_W}),
frame as (select p.symbol, p.date, close, coalesce({_clip('mo/0.5', -1.0, 1.0)},0.0) momentum,
 coalesce({_clip('(case when al>0 then 50-100/(1+ag/al) when ag>0 then 50.0 end)/30', -1.0, 1.0)},0.0) as rsi,
 {_clip(f"(coalesce({_clip('h/close*100', -0.7, 0.7)},0.0)+case when hp<0 and h>0 then 0.3 when hp>0 and h<0 then -0.3 else 0.0 end)", -1.0, 1.0)} as macd,
 (case when close>a20 then 0.25 else -0.25 end+case when close>a50 then 0.25 else -0.25 end+case when a20>a50 then 0.5 else -0.5 end)::double as trend_ma,
 coalesce(case when d20>0 then {_clip('(0.5-(close-(a20-2*d20))/(4*d20))*2', -1.0, 1.0)} end,0.0) as bollinger,
 coalesce((case when v>1.5 then least(v/3,1.0) when v>=1.2 then 0.3 else 0.0 end)*sign(r5),0.0) as volume,
 coalesce(case when s60>0 then {_clip('(1-s20/s60)/0.4', -1.0, 1.0)} end,0.0) as volatility, coalesce({_clip('rs/0.2', -1.0, 1.0)},0.0) as relative_strength,
 coalesce(sector_rotation,0.0) as sector_rotation, coalesce(vix_score,0.0) as vix_regime, coalesce(trend,0.0) as nifty_trend, coalesce(markov,0.0) as markov_regime, coalesce(delivery,0.0) as delivery_score, coalesce(flow_score,0.0) as fii_fo_score,
 overnight_gap, intraday_range_ratio, last_hour_momentum, vwap_deviation, opening_drive_vol, closing_spike_vol, vol_concentration from p4 p left join intra using (symbol, date))"""

_NAMES = ["rsi", "macd", "trend_ma", "bollinger", "volume", "volatility", "relative_strength", "sector_rotation", "vix_regime", "nifty_trend", "markov_regime", "delivery_score", "fii_fo_score"]
_DAY = ["overnight_gap", "intraday_range_ratio", "last_hour_momentum", "vwap_deviation", "opening_drive_vol", "closing_spike_vol", "vol_concentration"]

# the data set: the longest forward return is known, 60 such rows a symbol, rows in order of (date, symbol)
SET = f"""
e0 as (select *, {', '.join(f'lead(close,{h}) over w/close-1 fwd{h}' for h in (1, 5, 10, 20))}, greatest(-1.0,least(1.0,momentum*0.15+bollinger*0.15+rsi*0.15+macd*0.12+volatility*0.20+volume*0.05+relative_strength*0.08)) linear from frame {_W}),
e1 as (select *, count(*) over (partition by symbol) k from e0 where fwd20 is not null),
data as (select *, row_number() over (order by date, symbol)-1 ordinal, count(*) over () as row_count, dense_rank() over (order by date)-1 as day from e1 where k>=60)"""

# fold k of 5 tests the k-th of the five last sixths and learns from rows before it, less the 20 dates before its first
FOLDS = """
fd as (select unnest(range(1,6)) fold), fs as (select fold, max(row_count)-(6-fold)*(max(row_count)//6) lo, max(row_count)-(5-fold)*(max(row_count)//6) hi from data, fd group by fold),
fp as (select f.fold, f.lo, f.hi, greatest(0,d.day-20) as from_day from fs f join data d on d.ordinal=f.lo)"""

SQL = {
    "intraday_features": _sql("bars sessions", f"select symbol, date, {', '.join(f'round({c},6) as {c}' for c in _DAY)} from intra", INTRADAY),
    "feature_frame": _sql(TABLES, f"select symbol, date, {', '.join(f'round({c},6) as {c}' for c in _NAMES + _DAY)} from frame", FRAME),
    "training_counts": _sql(TABLES, "select symbol, count(*) as n, min(date) as first_date, max(date) as last_date, round(avg(linear),6) as linear, round(avg(fwd20),6) as fwd20 from data group by symbol", FRAME + "," + SET),
    "walk_forward_folds": _sql(
        TABLES,
        """select fold, count(*) filter (ordinal<lo and d.day<fp.from_day) as train_rows, count(*) filter (ordinal<lo and d.day>=fp.from_day) as purged_rows, count(*) filter (ordinal>=lo and ordinal<hi) as test_rows,
 max(d.date) filter (ordinal<lo and d.day<fp.from_day) as train_end, min(d.date) filter (ordinal>=lo and ordinal<hi) as test_start, max(d.date) filter (ordinal>=lo and ordinal<hi) as test_end from fp, data d group by fold""",
        FRAME + "," + SET + "," + FOLDS,
    ),
    "effective_sample": UNIQUENESS.rsplit("\nselect", 1)[0] + """, uw as (select symbol, t0, t1, avg(1.0::double/c) w from sp join alive on d between t0 and t1 group by symbol, t0, t1)
select symbol, count(w) as n, round(sum(w)*sum(w)/sum(w*w),6) as effective from uw group by symbol""",
}
