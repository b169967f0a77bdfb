"""DuckDB's SQL for the queries of ``operators.research``, written from the definitions."""

from __future__ import annotations

from marlstone.functions.expr import PPF_A, PPF_B, PPF_C, PPF_D, PPF_TAIL
from marlstone.plans.oracle import _FWD, _SCORES, _sql
from marlstone.plans.oracle_more import _R1, _RANK, _REV, _W


def _poly(factors: list[float], x: str) -> str:
    top = len(factors) - 1
    return "(" + "+".join(f"({f!r}::double)*pow({x},{top - k})" for k, f in enumerate(factors)) + ")"


def _quantile(p: str) -> str:
    t, r = f"sqrt(-2*ln(1-{p}))", f"pow({p}-0.5,2)"
    return f"(case when {p}>{1 - PPF_TAIL}::double then -{_poly(PPF_C, t)}/{_poly(PPF_D, t)} else ({p}-0.5)*{_poly(PPF_A, r)}/{_poly(PPF_B, r)} end)"


def _normal(z: str) -> str:
    t = f"(1/(1+0.2316419*abs({z})))"
    tail = f"exp(-{z}*{z}/2)/2.5066282746310002*({t}*(0.319381530+{t}*(-0.356563782+{t}*(1.781477937+{t}*(-1.821255978+{t}*1.330274429)))))"
    return f"(case when {z}>=0 then 1-{tail} else {tail} end)"


_DSR = f"""{_R1}, mo as (select symbol, avg(r) m, count(r) n, avg(r)/stddev_samp(r) sr, stddev_pop(r) s from r1 where r is not null group by symbol),
q as (select symbol, n, sr, avg(pow((r-m)/s,3)) g3, avg(pow((r-m)/s,4)) g4 from r1 join mo using (symbol) where r is not null group by symbol, n, sr),
fl as (select sqrt(var_samp(sr))*((1-0.5772156649015329::double)*{_quantile('(1-1/count(sr)::double)')}+0.5772156649015329::double*{_quantile('(1-1/(count(sr)*exp(1.0::double)))')}) f from q),
z as (select symbol, n, sr, f, (sr-f)*sqrt(n-1)/sqrt(greatest(1-g3*sr+(g4-1)/4*sr*sr,1e-12)) z from q, fl)"""
_MONTHS = f"""p as (select symbol, date, close, lag(close,21) over w/lag(close,252) over w-1 mom, row_number() over w bar from bars {_W}),
e0 as (select max(date) date from bars group by date_trunc('month',date)), e1 as (select date, lead(date) over (order by date) settle from e0),
f0 as (select p.symbol, p.date, settle, mom, b.close/p.close-1 fwd from p join e1 using (date) join bars b on b.symbol=p.symbol and b.date=settle where bar>252 and mom is not null),
f1 as (select *, count(*) over (partition by date) n, row_number() over (partition by date order by mom desc, symbol) u, row_number() over (partition by date order by mom, symbol desc) d from f0),
f2 as (select *, greatest(floor(n*0.1::double),2) k, dense_rank() over (order by date) o from f1 where n>=10),
f3 as (select a.date, a.settle, max(a.n) n, avg(a.fwd) filter (a.u<=5) lo_gross, 1-count(*) filter (a.u<=5 and b.u<=5)/5.0::double lo_turnover, avg(a.fwd) filter (a.u<=a.k)-avg(a.fwd) filter (a.d<=a.k) ls_gross,
 1-(count(*) filter (a.u<=a.k and b.u<=b.k)+count(*) filter (a.d<=a.k and b.d<=b.k))/(count(*) filter (a.u<=a.k)+count(*) filter (a.d<=a.k))::double ls_turnover from f2 a left join f2 b on a.symbol=b.symbol and a.o=b.o+1 group by a.date, a.settle),
mm as (select f3.*, lo_gross-0.006::double*lo_turnover lo_net, ls_gross-0.012::double*ls_turnover ls_net, y.close/x.close-1 bench, lo_gross-0.006::double*lo_turnover-(y.close/x.close-1) excess from f3 join bench x using (date) join bench y on y.date=settle)"""
_GATES = f"""{_MONTHS}, g0 as (select count(*) as months, avg(lo_net)*12 lo_return, avg(lo_net)/stddev_samp(lo_net)*sqrt(12.0::double) lo_sharpe, avg(excess)*12 lo_excess, avg(case when excess>0 then 1.0::double else 0.0 end) hit, avg(ls_net)/stddev_samp(ls_net) sr, skewness(ls_net) g3, kurtosis(ls_net)+3 g4 from mm),
g1 as (select *, sr*sqrt(months-1)/sqrt(greatest(1-g3*sr+(g4-1)/4*sr*sr,1e-9)) z from g0), g2 as (select *, {_normal('z')} psr, sr*sqrt(12.0::double) ls_sharpe from g1)"""
_PCT = f"{_REV}, pc as (select symbol, date, ({_RANK.format(by='date', x='rev3')})/count(*) over (partition by date) pct from rv where rev3 is not null)"
_EVENTS = f"""{_SCORES}, {_PCT},
t0 as (select symbol, date, close, composite, pct from f4 left join pc using (symbol, date)),
t1 as (select symbol, date, row_number() over w-1 bar, composite c, lag(composite) over w pc, case when lead(pct) over w>=0.5 then 0 when lead(pct,2) over w>=0.5 then 1 else 2 end waited, lead(close,1) over w i0, lead(close,2) over w i1, lead(close,3) over w i2, lead(close,21) over w x from t0 {_W}),
t2 as (select 'signal' cohort, * from t1 where c>=40 and pc<40 and x is not null union all select 'steady', * from t1 where bar>=30 and (bar-30)%5=0 and x is not null),
ev as (select cohort, symbol, date, waited, x/i0-1 ret_base, x/(case waited when 0 then i0 when 1 then i1 else i2 end)-1 ret_timed from t2), tv as (select *, ret_timed-ret_base diff from ev)"""
_TIMING = f"""{_EVENTS}, s as (select cohort, count(*) n, avg(case when waited>0 then 1.0::double else 0.0 end) waited_share, avg(waited) waited_mean, avg(diff) mean_diff, quantile_cont(diff,0.5) median_diff, avg(case when diff>0 then 1.0::double else 0.0 end) hit from tv group by cohort),
m as (select cohort, count(*) as months, avg(x)/stddev_samp(x)*sqrt(count(*)) t_monthly from (select cohort, avg(diff) x from tv group by cohort, date_trunc('month',date)) group by cohort),
y as (select cohort, arg_min(y,x) worst_year from (select cohort, cast(year(date) as int) y, avg(diff) x from tv group by 1, 2) group by cohort)"""
_CYCLES = """l as (select date, ln(close/lag(close) over (order by date)) x from bench),
b as (select date, case when count(x) over f=21 then stddev_samp(x) over f*sqrt(252.0::double)*100 end realised from l window f as (order by date rows between 1 following and 21 following)),
c0 as (select date, vix, realised, row_number() over (order by date)-1 o from b join market_regime using (date) where realised is not null),
cy as (select date, vix, realised, (vix*vix-realised*realised)/(2*vix) gross, (vix*vix-realised*realised)/(2*vix)-0.8::double net from c0 where o%21=0)"""
_HARVEST = f"""{_CYCLES}, qs as (select quantile_cont(vix,1/3.0::double) q1, quantile_cont(vix,2/3.0::double) q2 from cy),
h0 as (select 'all' part, date, net from cy union all select case when vix<=q1+1e-9 then 'low' when vix<=q2+1e-9 then 'mid' else 'high' end, date, net from cy, qs),
h1 as (select *, sum(net) over (partition by part order by date rows between unbounded preceding and current row) eq from h0), h2 as (select *, eq-max(eq) over (partition by part order by date rows between unbounded preceding and current row) fall from h1)"""
_K = f"{_R1}, k as (select symbol, r, row_number() over (partition by symbol order by date desc) k from r1 where r is not null qualify k<=250), cm as (select x.symbol a, y.symbol b, coalesce(corr(x.r,y.r),0.0) corr from k x join k y on x.k=y.k and x.symbol<y.symbol group by 1,2)"

# the weights go round by round, as they are told: at most as many rounds as factors
_IC = f"""{_SCORES}, {_FWD}, i0 as (select f4.*, fwd20, row_number() over (partition by symbol order by date desc) k from f4 join r using (symbol, date)),
i1 as (select factor, date, score, fwd20 from (select date, fwd20, momentum, bollinger, volatility, volume from i0 where k<=252) unpivot (score for factor in (momentum, bollinger, volatility, volume)) where fwd20 is not null),
i2 as (select factor, date, rank() over (partition by factor, date order by score)+(count(*) over (partition by factor, date, score)-1)/2.0::double a, rank() over (partition by factor, date order by fwd20)+(count(*) over (partition by factor, date, fwd20)-1)/2.0::double b from i1),
i3 as (select factor, date, corr(a,b) ic from i2 group by factor, date having count(*)>=5 and stddev_pop(a)>1e-12 and stddev_pop(b)>1e-12),
i4 as (select factor, avg(ic) mean_ic, count(*) dates from i3 group by factor),
st(factor, static) as (values ('momentum',0.4::double),('bollinger',0.2::double),('volatility',0.2::double),('volume',0.2::double)),
g as (select factor, static, mean_ic, dates, case when dates>=20 and mean_ic>=0.02 then mean_ic else 0.0::double end g from st left join i4 using (factor)),
k0 as (select *, coalesce(g/nullif(sum(g) over (),0),static) w from g),
k1 as (select *, least(w,0.4::double) c, sum(greatest(w-0.4::double,0)) over () x, sum(case when g>0 and w<0.4::double-1e-12 then w end) over () p, sum(case when g=0 then static end) over () z from k0),
k2 as (select factor, static, mean_ic, dates, g, case when x<=1e-12 then w when p>0 then case when g>0 and w<0.4::double-1e-12 then w+x*w/p else c end when g=0 then x*static/z else c end w from k1),
k3 as (select *, least(w,0.4::double) c, sum(greatest(w-0.4::double,0)) over () x, sum(case when g>0 and w<0.4::double-1e-12 then w end) over () p, sum(case when g=0 then static end) over () z from k2),
k4 as (select factor, mean_ic, dates, sum(g) over () s, case when x<=1e-12 or not bool_or(g>0) over () then w when p>0 then case when g>0 and w<0.4::double-1e-12 then w+x*w/p else c end when g=0 then x*static/z else c end w from k3)"""


def _six(*names: str) -> str:
    return ", ".join(f"round({n},6) as {n}" for n in names)


SQL = {
    "ic_weights": _sql("bars", "select factor, round(mean_ic,6) as mean_ic, dates, round(w,4) as weight, case when s>0 then 'ic' else 'static' end as method from k4", _IC),
    "deflated_sharpe": _sql("bars", f"select symbol, n, round(sr,6) as sr, round(f,6) as expected_max, round({_normal('z')},6) as dsr from z", _DSR),
    "even_legs": _sql("bars", "select date, max(n) as n, max(k) as names, round(avg(fwd1) filter (u<=k),6) as long_only, round(avg(fwd1) filter (u<=k)-avg(fwd1) filter (d<=k),6) as long_short from e2 group by date", f"e0 as (select symbol, date, 1-close/lag(close,3) over w rev3, lead(close) over w/close-1 fwd1 from bars {_W}), e1 as (select *, count(*) over (partition by date) n, row_number() over (partition by date order by rev3 desc, symbol) u, row_number() over (partition by date order by rev3, symbol desc) d from e0 where rev3 is not null and fwd1 is not null), e2 as (select *, greatest(cast(round_even(n*0.1::double,0) as bigint),1) k from e1)"),
    "monthly_momentum": _sql("bars bench", f"select date, settle, n, {_six('lo_gross', 'lo_turnover', 'lo_net', 'ls_gross', 'ls_turnover', 'ls_net', 'bench', 'excess')} from mm", _MONTHS),
    "momentum_gates": _sql("bars bench", f"select months, {_six('lo_return', 'lo_sharpe', 'lo_excess', 'hit', 'ls_sharpe', 'psr')}, coalesce(months>=24 and ls_sharpe>0.6 and psr>0.95 and lo_excess>0,false) as passed from g2", _GATES),
    "entry_timing": _sql("bars", f"select cohort, symbol, date, waited, {_six('ret_base', 'ret_timed', 'diff')} from tv", _EVENTS),
    "timing_summary": _sql("bars", "select cohort, n, " + ", ".join(f"case when n>=30 then {c if c in ('months', 'worst_year') else f'round({c},6)'} end as {c}" for c in ("months", "waited_share", "waited_mean", "mean_diff", "median_diff", "hit", "t_monthly", "worst_year")) + " from s join m using (cohort) join y using (cohort)", _TIMING),
    "harvest_cycles": _sql("market_regime bench", f"select date, vix, {_six('realised', 'gross', 'net')} from cy", _CYCLES),
    "harvest_summary": _sql("market_regime bench", "select part, count(*) as n, round(avg(net),6) as mean, round(avg(net)/stddev_samp(net)*sqrt(12.0::double),6) as sharpe, round(avg(case when net>0 then 1.0::double else 0.0 end),6) as hit, round(min(net),6) as worst, round(min(fall),6) as max_fall from h2 group by part", _HARVEST),
    "rebuilt_spells": _sql("spells", "select index_name, symbol, effective_from, effective_to from spells"),
    "high_correlations": _sql("bars", "select a, b, round(corr,6) as corr, case when corr>0 then 'positive' else 'negative' end as kind, case when corr>0.8 then 'together' when corr< -0.8 then 'opposite' else 'moderate' end as risk from cm where abs(corr)>=0.1", _K),
    "diversification": _sql("bars", "select round(v,6) as average, n as pairs, case when v<0.3 then 'excellent' when v<0.5 then 'good' when v<0.7 then 'moderate' else 'poor' end as level from (select coalesce(avg(abs(corr)),0.0) v, count(*) n from cm)", _K),
    "parsed_members": _sql("spells", "select cast(symbol as varchar) as symbol, index_name, effective_from, effective_to from spells"),
    "parsed_index_levels": _sql("market_regime", "select date, vix from market_regime"),
    "parsed_flow_pages": _sql("market_regime", "select date, round(flow,6) as fii, cast(fo_net_long as double) as dii from market_regime"),
    "parsed_deals": _sql("deals", "select cast(symbol as varchar) as symbol, date, trade_type as side, count(*) as n, cast(sum(quantity*1000) as bigint) as quantity, max(client_name) as client from deals group by symbol, date, trade_type"),
}
