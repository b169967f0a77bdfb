"""The same results in DuckDB's SQL, written from the definitions and not from the operators."""

from __future__ import annotations

from marlstone.sources.adapters import oracle_with

_W = "window w as (partition by symbol order by date)"


def _sql(tables: str, body: str, steps: str = "") -> str:
    return oracle_with(*tables.split()) + (", " + steps.strip() if steps else "") + "\n" + body.strip()


def _last(n: int) -> str:
    return f"over (partition by symbol order by date rows between {n - 1} preceding and current row)"


def _roll(fn: str, x: str, n: int, least: int | None = None) -> str:
    return f"(case when count({x}) {_last(n)} >= {least or n} then {fn}({x}) {_last(n)} end)"


def _clip(x: str, a: float, b: float) -> str:
    return f"(case when {x} is not null then greatest({a}, least({b}, {x})) end)"


_SCORES = f"""
f1 as (select symbol, date, close, volume, close/lag(close,1) over w-1 r, close/lag(close,5) over w-1 r5, close/lag(close,21) over w-1 r21, close/lag(close,63) over w-1 r63, close/lag(close,126) over w-1 r126 from bars {_W}),
f2 as (select *, {_roll('avg', 'close', 20)} mid, {_roll('stddev_samp', 'close', 20)} sd, {_roll('stddev_samp', 'r', 20)} s20, {_roll('stddev_samp', 'r', 60)} s60, volume/{_roll('avg', 'volume', 20)} v from f1),
f3 as (select symbol, date, close, coalesce({_clip('(0.2*r21+0.4*r63+0.4*r126)/0.5', -1.0, 1.0)},0.0) momentum,
 coalesce(case when sd>0 then {_clip('(0.5-(close-(mid-2*sd))/(4*sd))*2', -1.0, 1.0)} end,0.0) bollinger,
 coalesce(case when s60>0 then {_clip('(1-s20/s60)/0.4', -1.0, 1.0)} end,0.0) volatility,
 coalesce((case when v>1.5 then least(v/3,1.0) when v>=1.2 then 0.3 else 0.0 end)*sign(r5),0.0) volume from f2),
f4 as (select *, 100*(momentum*0.4+bollinger*0.2+volatility*0.2+volume*0.2) composite from f3)"""
_F4 = "symbol, date, close, round(momentum,6) momentum, round(bollinger,6) bollinger, round(volatility,6) volatility, round(volume,6) volume, round(composite,6) composite, case when composite>=40 then 'LONG' when composite<=-40 then 'SHORT' else 'HOLD' end as label"
_FWD = f"r as (select symbol, date, lead(close,20) over w/close-1 fwd20 from bars {_W})"


def _ic(score: str) -> str:
    return f"""{_SCORES}, {_FWD}, p as (select date, {score} a0, fwd20 b0 from f4 join r using (symbol, date) where fwd20 is not null),
k as (select date, rank() over (partition by date order by a0)+(count(*) over (partition by date, a0)-1)/2.0::double a, rank() over (partition by date order by b0)+(count(*) over (partition by date, b0)-1)/2.0::double b from p),
ic as (select date, count(*) n, case when stddev_pop(a)>1e-12 and stddev_pop(b)>1e-12 then corr(a,b) end ic from k group by date having count(*)>=5)"""


_HYST = f"""
z as (select symbol, date, close, (close-{_roll('avg', 'close', 20)})/{_roll('stddev_samp', 'close', 20)} z from bars),
h as (select symbol, date, close, z, coalesce(last_value(case when z<-1.5 then 1 when z>=0 then 0 end ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row),0) state from z)"""
_RUN = "over (partition by symbol order by date rows between unbounded preceding and current row)"
_CURVE = f"""{_HYST},
c1 as (select symbol, date, coalesce(lag(state) over w,0) "position", coalesce(close/lag(close) over w-1,0.0) ret from h {_W}),
c2 as (select *, "position"*ret-0.0015*abs("position"-coalesce(lag("position") over w,0)) net from c1 {_W}),
c3 as (select *, exp(sum(ln(1+net)) {_RUN}) equity, exp(sum(ln(1+ret)) {_RUN}) hold from c2),
curve as (select symbol, date, "position", net, equity, hold, equity/max(equity) {_RUN}-1 drawdown from c3),
e1 as (select *, case when "position"=1 and coalesce(lag("position") over w,0)=0 then 1 else 0 end s from curve {_W}),
e2 as (select *, sum(s) {_RUN} trade from e1),
trips as (select symbol, cast(trade as bigint) trade, min(date) entry_date, max(date) exit_date, count(*) bars, exp(sum(ln(1+net)))-1 ret from e2 where "position"=1 group by symbol, trade)"""
_SHORT = f"""
s1 as (select symbol, date, close/lag(close,1) over w-1 r1, close/lag(close,3) over w-1 r3, close/lag(close,5) over w-1 r5, lag(close,5) over w/lag(close,26) over w-1 mom, lead(close,1) over w/close-1 fwd1 from bars {_W}),
sh as (select symbol, date, -r1 rev1, -r3 rev3, -r5 rev5, case when v>0 then -r3/v end rev3_vol, mom mom21_skip5, -v lowvol, fwd1 from (select *, {_roll('stddev_samp', 'r1', 20)} v from s1))"""
_LEGS = f"""{_SHORT},
q1 as (select date, symbol, rev3, fwd1, count(*) over (partition by date) n from sh where rev3 is not null and fwd1 is not null),
q2 as (select *, greatest(cast(floor(n*0.2) as bigint),1) k, row_number() over (partition by date order by rev3 desc, symbol) u, row_number() over (partition by date order by rev3, symbol desc) d from q1 where n>=5),
legs as (select date, max(n) n, avg(case when u<=k then fwd1 end) top, avg(case when d<=k then fwd1 end) bottom from q2 group by date),
t1 as (select date, symbol from q2 where u<=k), dt as (select date, row_number() over (order by date) o from (select distinct date from t1)),
t2 as (select date, symbol, o from t1 join dt using (date)),
turn as (select a.date, 1-count(b.symbol)/count(*)::double turnover from t2 a left join t2 b on a.symbol=b.symbol and a.o=b.o+1 group by a.date)"""
_MARKOV = f"""
m0 as (select 'bench' symbol, date, close from bench), m1 as (select symbol, date, close/lag(close) over w-1 r from m0 {_W}),
m2 as (select symbol, date, case when r>0.005 then 1 when r< -0.005 then -1 when r is not null then 0 end s from m1),
m3 as (select symbol, date, s, lag(s) over w p, row_number() over w i from m2 {_W})"""
_DRIFT = f"""
v as (select symbol, date, sum(case when trade_type='BUY' then cast(quantity*price as decimal(18,2)) else 0 end) b, sum(case when trade_type='SELL' then cast(quantity*price as decimal(18,2)) else 0 end) s from deals where trade_type in ('BUY','SELL') and quantity>0 and price>0 group by symbol, date),
ev as (select symbol, date, cast(b-s as double)/cast(b+s as double) dominance from v where abs(cast(b-s as double)/cast(b+s as double))>0.5),
bb as (select symbol, date, lead(date) over w d0, lead(close) over w e0, lead(close,2) over w x1, lead(date,2) over w d1, lead(close,6) over w x5, lead(date,6) over w d5, lead(close,21) over w x20, lead(date,21) over w d20 from bars {_W}),
dr as (select ev.symbol, ev.date, case when dominance>0 then 'BUY' else 'SELL' end side, x1/e0-m1.close/m0.close car1, x5/e0-m5.close/m0.close car5, x20/e0-m20.close/m0.close car20
 from ev join bb on ev.symbol=bb.symbol and ev.date=bb.date join bench m0 on m0.date=d0 left join bench m1 on m1.date=d1 left join bench m5 on m5.date=d5 left join bench m20 on m20.date=d20)"""


_Q = "(19.0::double/21)"  # span 20
_BARRIERS = f"""
u0 as (select symbol, date, close, close/lag(close) over w-1 r from bars {_W}),
u1 as (select *, count(r) {_RUN} k from u0),
u2 as (select *, sum(r*pow({_Q},-k)) {_RUN}*pow({_Q},k) s1, sum(r*r*pow({_Q},-k)) {_RUN}*pow({_Q},k) s2, (1-pow({_Q},k))/(1-{_Q}) w1, (1-pow({_Q},2*k))/(1-{_Q}*{_Q}) w2 from u1),
u3 as (select *, case when k>=10 then sqrt(greatest(s2/w1-(s1/w1)*(s1/w1),0)*w1*w1/(w1*w1-w2)) end v,
 list(close) over (partition by symbol order by date rows between 1 following and 20 following) path, list(date) over (partition by symbol order by date rows between 1 following and 20 following) ahead from u2),
u4 as (select *, greatest(2.5*v,0.0015) w, coalesce(len(path)=20 and v is not null,false) known from u3),
lb as (select *, coalesce(list_position(list_transform(path, lambda p: abs(p/close-1-0.0015)>=w), true),0) hit from u4)"""


def _ewm(table: str, x: str, out: str, alpha: str, adjust: bool, least: int = 1) -> str:
    """Closed form over numbered rows: sum of x q^-k, times q^n."""
    q = f"(1-{alpha})"
    s = f"sum({x}*pow({q},-_n)) {_RUN}*pow({q},_n)"
    y = f"{alpha}*{s}/(1-pow({q},_n))" if adjust else f"{alpha}*{s}+pow({q},_n)*first_value({x} ignore nulls) {_RUN}"
    return f"(select *, case when _n>={least} then {y} end {out} from (select *, count({x}) {_RUN} _n from {table}))"


def _pct(x: str) -> str:
    return f"""(select a.date, case when count(b.{x})>=30 and max(a.{x}) is not null then (count(*) filter (b.{x}<a.{x})+(count(*) filter (b.{x}=a.{x})+1)/2.0::double)/count(b.{x}) end p
 from g a join g b on b.i between a.i-251 and a.i group by a.date)"""


SQL = {
    "factor_rank_latest": _sql("bars", f"select {_F4}, row_number() over (order by round(composite,6) desc, symbol) as rank from (select * from f4 qualify row_number() over (partition by symbol order by date desc)=1)", _SCORES),
    "factor_scores": _sql("bars", f"select {_F4} from f4", _SCORES),
    "returns_forward": _sql("bars", "select symbol, date, close, " + ", ".join(f"round(close/lag(close,{k}) over w-1,6) as r{k}" for k in (1, 5, 21)) + ", " + ", ".join(f"round(lead(close,{k}) over w/close-1,6) as fwd{k}" for k in (1, 5, 10, 20)) + f", round(ln(close/lag(close) over w),6) as log_r1 from bars {_W}"),
    "sma_bollinger": _sql("bars", "select symbol, date, close, round(mid,6) as mid, round(mid+2*sd,6) as upper, round(mid-2*sd,6) as lower, round(case when sd>0 then (close-mid+2*sd)/(4*sd) end,6) as pct_b, round(4*pop/mid*100,6) as bandwidth, round(case when sd>0 then (close-mid)/sd when sd is not null then 0.0 end,6) as z from b", f"b as (select symbol, date, close, {_roll('avg', 'close', 20)} mid, {_roll('stddev_samp', 'close', 20)} sd, {_roll('stddev_pop', 'close', 20)} pop from bars)"),
    "drawdown_equity": _sql("bars", f"select symbol, date, round(e,6) as equity, round(max(e) {_RUN},6) as peak, round(e/max(e) {_RUN}-1,6) as drawdown from d", f"d as (select symbol, date, close/first_value(close) over w e from bars {_W})"),
    "rsi_ewm": _sql("bars", "select symbol, date, close, round(case when al=0 then 100.0 else 100-100/(1+ag/al) end,6) as rsi from y", f"d as (select symbol, date, close, close-lag(close) over w x from bars {_W}), g as (select *, greatest(x,0.0) gain, greatest(-x,0.0) loss from d), x as (select symbol, date, close, loss, ag from {_ewm('(select symbol,date,close,case when x is not null then gain end gain, case when x is not null then loss end loss from g)', 'gain', 'ag', '(1/14.0::double)', True, 14)}), y as (select * from {_ewm('x', 'loss', 'al', '(1/14.0::double)', True, 14)})"),
    "macd_ewm": _sql("bars", f"select symbol, date, close, round(m,6) as macd, round(sg,6) as signal, round(m-sg,6) as hist, case when lag(m-sg) over w<=0 and m-sg>0 then 'bullish' when lag(m-sg) over w>=0 and m-sg<0 then 'bearish' else 'none' end as crossing from s {_W}", f"f as (select symbol, date, close, ef from {_ewm('bars', 'close', 'ef', '(2/13.0::double)', False)}), l as (select symbol, date, close, ef-es m from {_ewm('f', 'close', 'es', '(2/27.0::double)', False)}), s as (select symbol, date, close, m, sg from {_ewm('l', 'm', 'sg', '(2/10.0::double)', False)})"),
    "atr_wilder": _sql("bars", "select symbol, date, tr, round(a,6) as atr from x", f"t as (select symbol, date, greatest(high-low, abs(high-lag(close) over w), abs(low-lag(close) over w)) tr from bars {_W}), x as (select * from {_ewm('t', 'tr', 'a', '(1/14.0::double)', False, 14)})"),
    "hysteresis_state": _sql("bars", "select symbol, date, round(z,6) as z, state from h", _HYST),
    "streaks": _sql("bars", "select symbol, date, move, row_number() over (partition by symbol, run order by date) as streak from c", f"a as (select symbol, date, coalesce(cast(sign(close-lag(close) over w) as int),0) move from bars {_W}), b as (select *, case when move=lag(move) over w then 0 else 1 end nw from a {_W}), c as (select *, sum(nw) {_RUN} run from b)"),
    "candles_15m": _sql("ticks", "select symbol, time_bucket(interval '15 minutes', ts) as start, arg_min(price, (ts, event_id)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, event_id)) as close, count(*) as n from ticks group by 1, 2"),
    "weekly_bars": _sql("bars", "select symbol, week_end, arg_min(open,date) as open, max(high) as high, min(low) as low, arg_max(close,date) as close, cast(sum(volume) as bigint) as volume from a where week_end<=last group by symbol, week_end", "a as (select *, cast(date+cast(((4-(isodow(date)-1))%7+7)%7 as int) as date) week_end, max(date) over (partition by symbol) last from bars)"),
    "month_ends": _sql("bars", "select cast(date_trunc('month',date) as date) as month, max(date) as last_date from bars group by 1"),
    "asof_align": _sql("bars market_regime", "select b.symbol, b.date, b.close as close, coalesce(m.vix,0.0) as vix from bars b asof left join (select date, vix from market_regime where fo_net_long>0) m on b.date>=m.date"),
    "nth_bar_returns": _sql("bars", "select s.symbol, s.date, n.date as entry_date, n.close as entry, round(x1/n.close-1,6) as ret1, round(x5/n.close-1,6) as ret5, round(x10/n.close-1,6) as ret10, round(x20/n.close-1,6) as ret20 from s asof left join n on s.symbol=n.symbol and s.date>=n.date", f"n as (select symbol, date, close, lead(close,1) over w x1, lead(close,5) over w x5, lead(close,10) over w x10, lead(close,20) over w x20 from bars {_W}), s as (select symbol, cast(m+k as date) date from (select distinct symbol, cast(date_trunc('month',date) as date) m from bars), (values (9),(24)) t(k))"),
    "relative_strength": _sql("bars bench", f"select symbol, date, close, m, round(close/lag(close,63) over w-m/lag(m,63) over w,6) as rs from a {_W}", "a as (select b.symbol, b.date, b.close, m.close m from bars b asof left join bench m on b.date>=m.date)"),
    "pit_filter": _sql("bars register", "select symbol, date, close from bars b where exists (select 1 from register m where m.index_name='1-URGENT' and m.symbol=b.symbol and b.date between m.effective_from and coalesce(m.effective_to, date '9999-12-31'))"),
    "pit_filter_spells": _sql("bars spells", "select symbol, date, close from bars b where exists (select 1 from spells m where m.index_name='1-URGENT' and m.symbol=b.symbol and b.date between m.effective_from and coalesce(m.effective_to, date '9999-12-31'))"),
    "members_on": _sql("spells", "select distinct index_name, symbol from spells where effective_from<=date '1998-03-31' and (effective_to is null or effective_to>=date '1998-03-31')"),
    "interval_errors": _sql("register", "select symbol, index_name, effective_from, 'inverted' as error from register where effective_to<effective_from union all select symbol, index_name, effective_from, 'duplicate' from g where n>1 union all select symbol, index_name, effective_from, 'overlap' from f where b>=effective_from", "g as (select *, row_number() over (partition by index_name, symbol, effective_from order by coalesce(effective_to, date '9999-12-31') desc) n from register where effective_to is null or effective_to>=effective_from), f as (select *, lag(coalesce(effective_to, date '9999-12-31')) over (partition by index_name, symbol order by effective_from) b from g where n=1)"),
    "upsert_replace": _sql("market_regime", "select date, vix, round(flow,6) as flow, cast(fo_net_long as double) as fo_net_long from market_regime where date<date '1998-01-01' union all select date, vix+1, null, null from market_regime where date>=date '1998-01-01'"),
    "upsert_ignore": _sql("market_regime", "select date, vix, round(flow,6) as flow, cast(fo_net_long as double) as fo_net_long from market_regime where date<date '1998-07-01' union all select date, vix+1, null, null from market_regime where date>=date '1998-07-01'"),
    "upsert_columns": _sql("market_regime", "select date, case when date>=date '1998-01-01' then vix+1 else vix end as vix, round(case when date<date '1998-07-01' then flow end,6) as flow, case when date<date '1998-07-01' then cast(fo_net_long as double) end as fo_net_long from market_regime"),
    "upsert_missing": _sql("market_regime", "select date, vix+1 as vix from market_regime where date>=date '1998-07-01'"),
    "freshness": _sql("bars ticks", "select table_name, max_date, case when max_date<date '2001-11-09' then (select count(*) from range(cast(max_date as timestamp)+interval 1 day, timestamp '2001-11-10', interval 1 day) t(d) where isodow(d)<6) else 0 end as lag_days, coalesce(case when max_date<date '2001-11-09' then (select count(*) from range(cast(max_date as timestamp)+interval 1 day, timestamp '2001-11-10', interval 1 day) t(d) where isodow(d)<6) else 0 end>2, true) as stale from f", "f as (select 'bars' table_name, max(date) max_date from bars union all select 'orders', cast(max(o_orderdate) as date) from orders union all select 'ticks', cast(max(ts) as date) from ticks)"),
    "ic_by_date": _sql("bars", "select date, n, round(ic,6) as ic from ic", _ic("momentum")),
    "ic_summary": _sql("bars", "select 'volatility' as factor, round(avg(ic),6) as mean_ic, round(avg(ic)/stddev_pop(ic),6) as icir, round(avg(ic)/stddev_samp(ic)*sqrt(count(*)),6) as t_stat, count(*) as dates from ic where ic is not null", _ic("volatility")),
    "cs_rank_label": _sql("bars", "select date, symbol, round(fwd20,6) as fwd20, round(case when count(*) over (partition by date)>=5 then (rank() over (partition by date order by fwd20)+(count(*) over (partition by date, fwd20)-1)/2.0::double)/count(*) over (partition by date)*2-1 end,6) as rank_label from r where fwd20 is not null", _FWD),
    "short_horizon_signals": _sql("bars", "select symbol, date, " + ", ".join(f"round({c},6) as {c}" for c in ("rev1", "rev3", "rev5", "rev3_vol", "mom21_skip5", "lowvol", "fwd1")) + " from sh", _SHORT),
    "short_horizon_counts": _sql("bars", "select signal, count(*) as n, round(avg(case when sign(score)=sign(fwd1) then 1.0::double else 0.0 end),6) as hit from (" + " union all ".join(f"select '{c}' signal, {c} score, fwd1 from sh" for c in ("rev1", "rev3", "rev5", "rev3_vol", "mom21_skip5", "lowvol")) + ") where score is not null and fwd1 is not null group by signal", _SHORT),
    "ls_quintile": _sql("bars", "select date, n, round(top,6) as top, round(bottom,6) as bottom, round(top-bottom,6) as spread from legs", _LEGS),
    "turnover": _sql("bars", "select date, round(turnover,6) as turnover from turn", _LEGS),
    "cost_sweep": _sql("bars", "select c as cost_bp, round(avg(net)*252,6) as annual, round(avg(net)/stddev_samp(net)*sqrt(252.0::double),6) as sharpe, count(*) as days from (select c, top-bottom-2*turnover*c/10000 net from legs join turn using (date), (values (0.0::double),(10.0::double),(30.0::double)) t(c)) group by c", _LEGS),
    "barrier_labels": _sql("bars", "select symbol, date, cast(case when known then case when hit=0 then 0 when path[hit]/close-1-0.0015>=w then 1 else -1 end end as int) as label, case when known then case when hit=0 then 20 else hit end end as bars_held from lb", _BARRIERS),
    "uniqueness_weights": _sql("bars", "select symbol, t0, t1, round(avg(1.0::double/c),6) as weight from sp join alive on d between t0 and t1 group by symbol, t0, t1", _BARRIERS + ", sp as (select symbol, date t0, ahead[cast(case when hit=0 then 20 else hit end as int)] t1 from lb where known), cal as (select distinct t0 d from sp), alive as (select d, count(*) c from cal join sp on d between t0 and t1 group by d)"),
    "purged_folds": _sql("bench", "select fold, date, case when o>=a and o<b then 'test' when o>=a-20 and o<b+20 then 'purged' else 'train' end as role from x", "d as (select date, row_number() over (order by date)-1 o, count(*) over () n from (select distinct date from bench)), x as (select date, o, cast(k as int) fold, floor(k*n/5.0) a, floor((k+1)*n/5.0) b from d, range(5) t(k))"),
    "backtest_equity": _sql("bars", 'select symbol, date, "position", round(net,6) as net, round(equity,6) as equity, round(hold,6) as hold, round(drawdown,6) as drawdown from curve', _CURVE),
    "trade_log": _sql("bars", "select symbol, trade, entry_date, exit_date, bars, round(ret,6) as ret from trips", _CURVE),
    "perf_stats": _sql("bars", "select symbol, n, round(cagr,6) as cagr, round(case when s>0 then m/s*sqrt(252.0::double) end,6) as sharpe, round(case when d>0 then m/d*sqrt(252.0::double) end,6) as sortino, round(mdd,6) as max_drawdown, round(case when mdd<0 then cagr/abs(mdd) end,6) as calmar from (select symbol, count(*) n, case when max(date)>min(date) then exp(sum(ln(1+net))*365.25/date_diff('day',min(date),max(date)))-1 end cagr, avg(net-0.06/252) m, stddev_samp(net) s, sqrt(avg(case when net-0.06/252<0 then (net-0.06/252)*(net-0.06/252) end)) d, min(drawdown) mdd from curve group by symbol)", _CURVE),
    "trade_stats": _sql("bars", "select symbol, count(*) as trades, round(avg(case when ret>0 then 1.0::double else 0.0 end),6) as win_rate, round(avg(case when ret>0 then ret end),6) as avg_win, round(avg(case when ret<0 then ret end),6) as avg_loss, round(case when sum(case when ret<0 then -ret end)>0 then least(sum(case when ret>0 then ret end)/sum(case when ret<0 then -ret end),99.9) when max(ret)>0 then 99.9 else 0.0 end,6) as profit_factor from trips group by symbol", _CURVE),
    "psr": _sql("bars", "select symbol, n, round(sr,6) as sr, round(case when z>=0 then 1-tail else tail end,6) as psr from (select *, exp(-z*z/2)/2.5066282746310002*(t*(0.319381530+t*(-0.356563782+t*(1.781477937+t*(-1.821255978+t*1.330274429))))) tail from (select *, 1/(1+0.2316419*abs(z)) t from (select *, sr*sqrt(n-1)/sqrt(1-g3*sr+(g4-1)/4*sr*sr) z from q)))", f"a as (select symbol, close/lag(close) over w-1 r from bars {_W}), mo as (select symbol, avg(r) m, count(r) n, avg(r)/stddev_samp(r) sr, stddev_pop(r) s from a where r is not null group by symbol), q as (select symbol, n, sr, avg(pow((r-m)/s,3)) g3, avg(pow((r-m)/s,4)) g4 from a join mo using (symbol) where r is not null group by symbol, n, sr)"),
    "markov_roll": _sql("bench", "select symbol, date, round(case when nstates>=60 then coalesce(u/n,0.0) else 0.0 end,6) as markov from (select a.symbol, a.date, count(b.s) filter (b.i>=a.i-60) nstates, sum(b.s) filter (b.i>=a.i-59 and b.p=l.s) u, nullif(count(*) filter (b.i>=a.i-59 and b.p=l.s),0)::double n from m3 a left join m3 b on b.i between a.i-60 and a.i-1 left join m3 l on l.i=a.i-1 group by a.symbol, a.date)", _MARKOV),
    "markov_matrix": _sql("bench", "select 'bench' as symbol, prev, state, count(*) as n, round(count(*)/sum(count(*)) over (partition by prev)::double,6) as p from (select case p when 1 then 'BULL' when -1 then 'BEAR' else 'SIDE' end prev, case s when 1 then 'BULL' when -1 then 'BEAR' else 'SIDE' end state from m3 where p is not null and s is not null) group by prev, state", _MARKOV),
    "regime_scores": _sql("market_regime", f"select g.date, vix, round(1-2*pv.p,6) as vix_score, round(flow10,6) as flow10, round(2*pf.p-1,6) as flow_score from g left join {_pct('vix')} pv on pv.date=g.date left join {_pct('flow10')} pf on pf.date=g.date", "g as (select date, vix, case when count(*) over (order by date rows 9 preceding)>=10 then sum(flow) over (order by date rows 9 preceding) end flow10, row_number() over (order by date) i from market_regime)"),
    "valuation_scores": _sql("fundamentals", f"select symbol, industry, round(({_clip('(20-pe_ratio)/20', -1.0, 1.0)}+{_clip('(3-pb_ratio)/3', -1.0, 1.0)})/2,6) as valuation, round(({_clip('1-debt_to_equity', -1.0, 1.0)}+{_clip('current_ratio-1', -1.0, 1.0)})/2,6) as health from fundamentals"),
    "dominance_events": _sql("deals bars bench", "select symbol, date, round(dominance,6) as dominance, case when dominance>0 then 'BUY' else 'SELL' end as side from ev", _DRIFT),
    "deal_drift": _sql("deals bars bench", "select symbol, date, side, round(car1,6) as car1, round(car5,6) as car5, round(car20,6) as car20 from dr", _DRIFT),
    "deal_drift_summary": _sql("deals bars bench", "select side, cast(sum(k) as bigint) as n, round(sum(t)/sum(k)*10000,6) as mean_bp, round(sum(up)/sum(k),6) as hit, round(avg(a)/(stddev_samp(a)/sqrt(count(*))),6) as t_stat from (select side, date_trunc('month',date) m, avg(car5) a, count(*) k, sum(car5) t, sum(case when car5>0 then 1 else 0 end) up from dr where car5 is not null group by 1,2) group by side", _DRIFT),
    "delivery_score": _sql("delivery", "select symbol, date, delivery_pct, round(z,6) as z, round(case when z is not null then greatest(-3.0,least(3.0,z))/3 end,6) as score from a", f"a as (select symbol, date, delivery_pct, (delivery_pct-{_roll('avg', 'delivery_pct', 60, 10)})/(case when {_roll('stddev_samp', 'delivery_pct', 60, 10)}=0 then 1.0 else {_roll('stddev_samp', 'delivery_pct', 60, 10)} end) z from delivery)"),
    "corr_matrix": _sql("bars", "select x.symbol as a, y.symbol as b, round(coalesce(corr(x.r,y.r),0.0),6) as corr, count(*) as n from k x join k y on x.k=y.k and x.symbol<y.symbol group by 1,2", f"d as (select symbol, date, close/lag(close) over w-1 r from bars {_W}), k as (select symbol, r, row_number() over (partition by symbol order by date desc) k from d where r is not null qualify k<=250)"),
    "position_sizes": _sql("bars", "select symbol, close, round(w,6) as weight, cast(floor(w*1000000.0/close) as bigint) as shares from (select symbol, close, least((1/sd)/sum(1/sd) over (),0.05) w from (select * from e qualify row_number() over (partition by symbol order by date desc)=1) where sd>0)", f"d as (select symbol, date, close, close/lag(close) over w-1 r from bars {_W}), e as (select symbol, date, close, {_roll('stddev_samp', 'r', 20)} sd from d)"),
    "iv_skew": _sql("option_chain", "select name, expiry_id, strikes, round((c50+p50)/2,6) as atm_iv, round(p25-c25,6) as rr25_skew from (select name, expiry_id, count(*) strikes, " + ", ".join(f"arg_min(iv, (abs(delta-({t})), option_id)) filter (abs(delta-({t}))<=0.15) {n}" for t, n in ((0.5, "c50"), (-0.5, "p50"), (0.25, "c25"), (-0.25, "p25"))) + " from option_chain group by 1,2)"),
    "ema_seeded": _sql("bars", "select symbol, date, close, round(e,6) as ema from x", f"a as (select symbol, date, close, row_number() over w k, avg(close) {_RUN} m from bars {_W}), b as (select symbol, date, close, case when k=20 then m when k>20 then close end v from a), x as (select * from {_ewm('b', 'v', 'e', '(2/21.0::double)', False)})"),
    "rsi_textbook": _sql("bars", "select symbol, date, close, round(case when l=0 then 100.0 else 100-100/(1+g/l) end,6) as rsi from y", f"d as (select symbol, date, close, close-lag(close) over w x from bars {_W}), a as (select symbol, date, close, count(x) {_RUN} k, case when x is not null then greatest(x,0.0) end g0, case when x is not null then greatest(-x,0.0) end l0 from d), b as (select symbol, date, close, case when k=14 then avg(g0) {_RUN} when k>14 then g0 end gv, case when k=14 then avg(l0) {_RUN} when k>14 then l0 end lv from a), x as (select symbol, date, close, lv, g from {_ewm('b', 'gv', 'g', '(1/14.0::double)', False)}), y as (select * from {_ewm('x', 'lv', 'l', '(1/14.0::double)', False)})"),
    "index_trend": _sql("bench", f"select symbol, date, close, round(coalesce({_clip('(close-a)/a*10', -1.0, 1.0)},0.0)*0.5+coalesce({_clip('(close-b)/b*10', -1.0, 1.0)},0.0)*0.5,6) as trend from t", f"m0 as (select 'bench' symbol, date, close from bench), t as (select *, {_roll('avg', 'close', 50, 30)} a, {_roll('avg', 'close', 200, 100)} b from m0)"),
    "sector_rotation": _sql("sector_index bench", f"select s.symbol, s.date, round(coalesce({_clip('(s.r-b.r)/0.2', -1.0, 1.0)},0.0),6) as rotation from s join b on s.date=b.date", f"s as (select index_name symbol, date, close/lag(close,20) over (partition by index_name order by date)-1 r from sector_index), b as (select date, close/lag(close,20) over (order by date)-1 r from bench)"),
    "cpcv_splits": _sql("bench", "select combo, date, case when bool_or(o>=floor(g*n/6.0) and o<floor((g+1)*n/6.0)) then 'test' when bool_or(o>=floor(g*n/6.0)-20 and o<floor((g+1)*n/6.0)+20) then 'purged' else 'train' end as role from d, p group by combo, date", "d as (select date, row_number() over (order by date)-1 o, count(*) over () n from (select distinct date from bench)), c as (select a.g a, b.g b, cast(row_number() over (order by a.g, b.g)-1 as int) combo from range(6) a(g) join range(6) b(g) on a.g<b.g), p as (select combo, a g from c union all select combo, b from c)"),
    "exposure_dial": _sql("bench", "select symbol, lag, cash, count(*) as n, round(exp(sum(ln(1+net))*252/count(*))-1,6) as cagr, round(avg(net)*252,6) as mean, round(stddev_samp(net)*sqrt(252.0::double),6) as vol from (select symbol, lag, c as cash, w*r+(1-w)*c/252-abs(w-coalesce(lag(w) over (partition by symbol, lag, c order by date),0.0))*0.0005 net from z, (values (0.0::double),(0.06::double)) v(c)) group by symbol, lag, cash", f"m0 as (select 'bench' symbol, date, close from bench), t as (select *, {_roll('avg', 'close', 50, 30)} a, {_roll('avg', 'close', 200, 100)} b from m0), u as (select symbol, date, close/lag(close) over w-1 r, greatest(0.0,least(1.0,0.5+coalesce({_clip('(close-a)/a*10', -1.0, 1.0)},0.0)*0.5+coalesce({_clip('(close-b)/b*10', -1.0, 1.0)},0.0)*0.5)) e from t {_W}), z as (select symbol, date, coalesce(r,0.0) r, cast(1 as int) lag, coalesce(lag(e,1) over w,0.0) w from u {_W} union all select symbol, date, coalesce(r,0.0), 2, coalesce(lag(e,2) over w,0.0) from u {_W})"),
    "counterparties": _sql("deals", "select case when contains(u,'FUND') then 'fund' when contains(u,'BANK') then 'bank' when contains(u,'#00000000') then 'house' when contains(u,'SUPPLIER') then 'trader' else 'other' end as kind, trade_type, count(*) as deals, round(cast(sum(cast(quantity*price as decimal(18,2))) as double),6) as value from (select *, upper(client_name) u from deals) where trade_type in ('BUY','SELL') group by 1, 2"),
    "variance_premium": _sql("market_regime bench", "select date, vix, round(rv,6) as realised, round(vix-rv,6) as premium from b join market_regime using (date) where rv is not null", "l as (select date, ln(close/lag(close) over (order by date)) x from bench), b as (select date, case when count(x) over f=21 then stddev_samp(x) over f*sqrt(252.0::double)*100 end rv from l window f as (order by date rows between 1 following and 21 following))"),
    "risk_report": _sql("bars bench", "select symbol, n, round(v,6) as volatility, round(beta,6) as beta, round(vr,6) as var from (select symbol, count(*) n, stddev_pop(r)*sqrt(252.0::double) v, -max(case when k=floor(c*0.05) then r end) vr from q group by symbol) left join (select symbol, case when count(*)>=30 then covar_pop(r,m)/var_pop(m) end beta from d join mm using (date) group by symbol) using (symbol)", f"d as (select symbol, date, r from (select symbol, date, close/lag(close) over w-1 r from bars {_W}) where r is not null), mm as (select date, m from (select date, close/lag(close) over (order by date)-1 m from bench) where m is not null), q as (select symbol, r, row_number() over (partition by symbol order by r)-1 k, count(*) over (partition by symbol) c from d)"),
    "sector_concentration": _sql("ledger", "select sleeve, round(cast(v as double),6) as value, round(cast(v as double)/cast(sum(v) over () as double),6) as share, cast(v as double)/cast(sum(v) over () as double)>0.25 as over from (select sleeve, sum(cast(qty*price as decimal(18,2))) v from ledger where side='BUY' group by sleeve)"),
    "condor_legs": _sql("option_chain", "select name, expiry_id, round(sc,6) as sell_call, round(bc,6) as buy_call, round(sp,6) as sell_put, round(bp,6) as buy_put, round(greatest(bc-sc,sp-bp),6) as width from (select name, expiry_id, " + ", ".join(f"arg_min(strike, (abs(delta-({t})), option_id)) filter (option_type='{k}') {n}" for t, k, n in ((0.25, "CE", "sc"), (0.1, "CE", "bc"), (-0.25, "PE", "sp"), (-0.1, "PE", "bp"))) + " from option_chain group by 1, 2) where bc>sc and sp>bp"),
}
