"""SQL of the ledger, its values by date, stops, retirement and earnings drift."""

from __future__ import annotations

from marlstone.plans.oracle import _SCORES, _sql

_ORDER = "trade_date, id, line, supp, side, qty, price, fees"
# trade by trade: buying adds to the cost, selling keeps the share that isn't sold
STATES = f"""
tr as (select sleeve, instrument, trade_date, side, qty, price, coalesce(fees,0) fees, row_number() over (partition by sleeve, instrument order by {_ORDER}) n,
 cast(sum(cast(case when side='BUY' then qty else -qty end as decimal(28,8))) over (partition by sleeve, instrument order by {_ORDER} rows unbounded preceding) as double) q from ledger where side in ('BUY','SELL')),
st as (select sleeve, instrument, n, trade_date, q, case when side='BUY' then qty*price+fees else 0.0 end invested from tr where n=1
 union all select t.sleeve, t.instrument, t.n, t.trade_date, t.q, case when t.side='BUY' then s.invested+t.qty*t.price+t.fees when s.q>0 then s.invested*(1-t.qty/s.q) else s.invested end from st s join tr t on t.sleeve=s.sleeve and t.instrument=s.instrument and t.n=s.n+1),
ds as (select sleeve, instrument, trade_date, arg_max(q,n) qty, arg_max(invested,n) invested, max(n) trades from st group by all),
cf as (select sleeve, trade_date as date, sum(case when side in ('SELL','DEPOSIT') then cast(qty*price as decimal(28,8))-cast(coalesce(fees,0) as decimal(28,8)) else -cast(qty*price as decimal(28,8))-cast(coalesce(fees,0) as decimal(28,8)) end) flow from ledger group by all)"""


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


_NAV = f"""{STATES},
cal as (select distinct trade_date as date from ledger),
sp as (select *, lead(trade_date) over (partition by sleeve, instrument order by trade_date) nxt from ds),
hd as (select sleeve, instrument, c.date, qty, invested from sp join cal c on c.date>=trade_date and (nxt is null or c.date<nxt) where qty>1e-9),
pr as (select h.*, p.close from hd h asof left join fund_prices p on p.instrument=h.instrument and h.date>=p.date),
wo as (select sleeve, date, sum(invested) invested, sum(coalesce(qty*close,invested)) market_value from pr group by all),
gr as (select sleeve, c.date from (select sleeve, min(date) f from cf group by sleeve) join cal c on c.date>=f),
mo as (select g.sleeve, g.date, cast(sum(coalesce(cf.flow,0)) over (partition by g.sleeve order by g.date) as double) cash from gr g left join cf using (sleeve, date)),
nav as (select sleeve, date, coalesce(invested,0.0) invested, coalesce(market_value,0.0) market_value, cash, coalesce(market_value,0.0)+cash nav from mo left join wo using (sleeve, date))"""

_FLAGS = f"""{STATES},
po as (select sleeve, instrument, arg_max(qty,trade_date) qty, arg_max(invested,trade_date) invested from ds group by all having arg_max(qty,trade_date)>1e-9),
lp as (select instrument, arg_max(close,date) price from fund_prices group by instrument),
mk as (select *, coalesce(qty*price,invested) v from po left join lp using (instrument)),
nv as (select (select sum(v) from mk)+(select cast(sum(flow) as double) from cf) nav),
mp as (select *, case when nav>0 then 100*v/nav else 0.0 end pct, case when price is not null and invested>0 then 100*(v-invested)/invested end fall from mk, nv),
bu as (select r_name sleeve, 20.0 budget from region),
fl as (select case when pct>25 then 'position_hard_cap' else 'position_cap' end kind, sleeve, instrument, case when pct>25 then 'critical' else 'warning' end severity, pct from mp where sleeve<>'ASIA' and pct>15
 union all select 'position_drawdown', sleeve, instrument, 'warning', fall from mp where fall< -20
 union all select 'sleeve_budget', sleeve, null, 'warning', p from (select sleeve, budget, 100*coalesce(sum(v),0.0)/max(nav) p, max(nav) nav from bu left join mk using (sleeve), nv group by sleeve, budget) where nav>0 and p>budget+5)"""

_ATR = "(1/14.0::double)"
_RUN = "over (partition by symbol order by date rows between unbounded preceding and current row)"
_STOPS = f"""
b0 as (select symbol, date, high, low, close, row_number() over w i, count(*) over (partition by symbol) n, lag(close) over w pc from bars window w as (partition by symbol order by date)),
b1 as (select *, case when pc is not null then greatest(high-low,abs(high-pc),abs(low-pc)) end tr, ln(close/pc) lr from b0),
b2 as (select *, case when count(tr) {_RUN}=14 then avg(tr) {_RUN} when count(tr) {_RUN}>14 then tr end x from b1),
b3 as (select *, count(x) {_RUN} k from b2),
b4 as (select *, case when k>=1 then {_ATR}*sum(x*pow(1-{_ATR},-k)) {_RUN}*pow(1-{_ATR},k)+pow(1-{_ATR},k)*first_value(x ignore nulls) {_RUN} end atr,
 case when count(lr) over (partition by symbol order by date rows 19 preceding)>=20 then stddev_samp(lr) over (partition by symbol order by date rows 19 preceding) end sd,
 case when count(high) over (partition by symbol order by date rows 21 preceding)>=22 then max(high) over (partition by symbol order by date rows 21 preceding) end top from b3),
en as (select symbol, date entry_date, close entry_price from b0 where i=n-60),
s1 as (select b.symbol, entry_date, date, close, entry_price*(1-2.5*sd) vol_stop, top-3.0*atr trail_stop, greatest(entry_price*(1-2.5*sd), top-3.0*atr) stop from b4 b join en using (symbol) where date>=entry_date),
s2 as (select *, max(stop) over (partition by symbol order by date) ratchet from s1)"""

_DRIFT = """
fb as (select symbol, period, min(ts) ts from filings group by all),
bp as (select symbol, date, close/lag(close) over w-1 r, lead(close,5) over w/close-1 f5, lead(close,20) over w/close-1 f20, lead(close,60) over w/close-1 f60, count(*) over (partition by symbol) n from bars window w as (partition by symbol order by date)),
mk as (select date, close/lag(close) over w-1 m, lead(close,5) over w/close-1 m5, lead(close,20) over w/close-1 m20, lead(close,60) over w/close-1 m60 from bench window w as (order by date)),
ev as (select symbol, period, cast(ts as date) d0, case when cast(ts as time)<=time '15:30:00' then cast(ts as date) else cast(ts as date)+1 end at_day from fb),
rb as (select e.symbol, e.period, e.d0, b.* exclude (symbol) from ev e asof join bp b on b.symbol=e.symbol and e.at_day<=b.date where date_diff('day', e.d0, b.date)<=5 and b.n>=80),
dr as (select symbol, period, date, year(date)||'Q'||quarter(date) as quarter, r-m reaction, f5-m5 ar5, f20-m20 ar20, f60-m60 ar60 from rb join mk using (date) where r-m is not null and f60-m60 is not null),
tc as (select *, row_number() over (partition by quarter order by reaction, date, symbol, period)-1 r, count(*) over (partition by quarter)-1 n from dr),
te as (select * exclude (r,n), case when 3*r<=n then 'T1_neg' when 3*r<=2*n then 'T2_mid' else 'T3_pos' end tercile from tc)"""

_GATES = f"""{_SCORES},
lk as (select symbol, date, avg(volume) over (partition by symbol order by date rows 19 preceding)*10000 adv, row_number() over (partition by symbol order by date) points from bars),
rv as (select symbol, date, 1-close/lag(close,3) over (partition by symbol order by date) x from bars),
pc as (select symbol, date, (rank() over (partition by date order by x)+(count(*) over (partition by date, x)-1)/2.0::double)/count(*) over (partition by date) pct from rv where x is not null),
gt as (select f.symbol, f.date, concat_ws(',', case when composite>=40 then null else 'composite' end, case when composite>=40 then null else 'linear_agreement' end, case when month(f.date)%2=0 and abs(composite)<40 then 'ml_confidence' end,
 case when pct>=0.75 then null else 'meta_labeler' end, case when adv>=500000 then null else 'liquidity_adv' end, case when points>=200 then null else 'data_points' end) failed from f4 f join lk using (symbol, date) left join pc using (symbol, date))"""

SQL = {
    "conviction": _sql("bars", "select symbol, date, failed='' as passed, failed from gt", _GATES),
    "ledger_positions": _recursive(_sql("ledger", "select sleeve, instrument, trades, round(qty,6) as qty, round(invested,6) as invested, round(invested/qty,6) as avg_cost from (select sleeve, instrument, max(trades) trades, arg_max(qty,trade_date) qty, arg_max(invested,trade_date) invested from ds group by all) where qty>1e-9", STATES)),
    "ledger_cash": _sql("ledger", "select sleeve, round(cast(sum(flow) as double),6) as cash, (select count(*) from ledger l where l.sleeve=cf.sleeve) as rows from cf group by sleeve", STATES[STATES.index("cf as") :]),
    "nav_history": _recursive(_sql("ledger fund_prices", "select sleeve, date, round(invested,2) as invested, round(market_value,2) as market_value, round(cash,2) as cash, round(nav,2) as nav from nav", _NAV)),
    "fund_flags": _recursive(_sql("ledger fund_prices", "select kind, sleeve, cast(instrument as varchar) as instrument, severity, round(pct,6) as pct from fl", _FLAGS)),
    "hybrid_stops": _sql(
        "bars",
        """select symbol, entry_date, date, close, round(vol_stop,6) as vol_stop, round(trail_stop,6) as trail_stop, round(stop,6) as stop, case when stop is null then null when stop=vol_stop then 'hybrid:volatility' else 'hybrid:chandelier' end as method,
 round(100*(close-stop)/stop,6) as distance_pct, coalesce(close<=stop,false) as triggered, round(ratchet,6) as ratchet, bool_or(coalesce(close<=ratchet,false)) over (partition by symbol order by date) as stopped from s2""",
        _STOPS,
    ),
    "retired_bars": _sql(
        "bars",
        "select symbol, date, close from (select *, max(case when g>=5 then 1 else 0 end) over (partition by symbol order by date) gone from (select symbol, date, close, o-lag(o) over (partition by symbol order by date)-1 g from bars join (select date, row_number() over (order by date) o from (select distinct date from bars)) using (date))) where gone=0",
    ),
    "earnings_drift": _sql("filings bars bench", "select symbol, period, date, quarter, round(reaction,6) as reaction, round(ar5,6) as ar5, round(ar20,6) as ar20, round(ar60,6) as ar60, tercile from te", _DRIFT),
    "earnings_drift_table": _sql(
        "filings bars bench",
        """, lg as (select tercile, date, reaction, unnest([5,20,60]) horizon, unnest([ar5,ar20,ar60]) ar from te),
mm as (select tercile, horizon, count(*) as n_months, avg(a)*sqrt(count(a))/stddev_samp(a) t from (select tercile, horizon, date_trunc('month',date) m, avg(ar) a from lg group by all) group by all),
ww as (select tercile, horizon, count(*) n, avg(reaction)*1e4 rb, avg(ar)*1e4 mb, quantile_cont(ar,0.5)*1e4 md, avg(case when ar>0 then 1.0::double else 0.0 end)*100 hit from lg group by all)
select tercile, horizon, n, n<50 as insufficient, case when n>=50 then round(rb,6) end as reaction_bp, case when n>=50 then round(mb,6) end as mean_bp, case when n>=50 then round(md,6) end as median_bp, case when n>=50 then round(hit,6) end as hit_pct,
 case when n>=50 then round(t,6) end as t_monthly, case when n>=50 then n_months end as months from ww join mm using (tercile, horizon)""".lstrip(),
        _DRIFT,
    ).replace("\n, lg as", ", lg as"),
}
