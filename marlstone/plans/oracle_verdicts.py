"""SQL of verdicts, the signals log and queue, strategies, replies and daily sentiment, condors and tranches."""

from __future__ import annotations

from marlstone.operators.studies import LEXICON
from marlstone.operators.verdicts import GROWTH, HEALTH, VALUATION, WEIGHTS
from marlstone.plans.oracle import _clip, _roll, _sql
from marlstone.plans.oracle_frame import FRAME, MARKET, TABLES
from marlstone.plans.oracle_fund import _GATES, _STOPS

_W = "window w as (partition by symbol order by date)"


def _mean(rows: list, more: str = "") -> str:
    parts = [f"case when {c}{'>0' if positive else ' is not null'} then {_clip(f'({c}-({m}))/({s})', -1.0, 1.0)} end" for c, m, s, positive in rows]
    return f"coalesce(list_avg([{', '.join(parts)}{more}]),0.0)"


_FUNDAMENTALS = f"""fsc as (select symbol, {_mean(VALUATION)} valuation, {_mean(HEALTH, ', case when free_cash_flow>0 then 0.5 when free_cash_flow is not null then -0.5 end')} financial_health,
 {_mean(GROWTH, ', ' + _clip('(net_margin_ttm-net_margin_5y)/nullif(abs(net_margin_5y),0)/0.3', -1.0, 1.0))} growth from financials)"""
_RATINGS = "rsc as (select symbol, (coalesce(strong_buy,0)+coalesce(buy,0)-coalesce(sell,0)-coalesce(strong_sell,0))/n::double analyst_consensus from (select *, coalesce(strong_buy,0)+coalesce(buy,0)+coalesce(hold,0)+coalesce(sell,0)+coalesce(strong_sell,0) n from ratings) where n>0)"
_PEERS = f"""
pk as (select symbol, date, close, row_number() over (partition by symbol order by date desc) k from bars),
pr as (select symbol, max(close) filter (k=1)/max(close) filter (k=20)-1 r from pk group by symbol),
pm as (select max(close) filter (k=1)/max(close) filter (k=20)-1 m from (select close, row_number() over (order by date desc) k from bench)),
pp as (select a.symbol, pr.r, row_number() over (partition by a.symbol order by b.symbol) i from sector_of a join sector_of b on b.sector=a.sector and b.symbol<>a.symbol left join pr on pr.symbol=b.symbol),
psc as (select o.symbol, coalesce({_clip('(x-coalesce(m,0.0))/0.2', -1.0, 1.0)},0.0) sector_rotation from sector_of o left join (select symbol, avg(r) x from pp where i<=20 group by symbol) using (symbol), pm)"""
_PLACE = """
ho as (select date, fo_net_long x, row_number() over (order by date) i from market_regime),
hp as (select a.date, case when count(*)>=30 then 2*(count(*) filter (b.x<a.x)+(count(*) filter (b.x=a.x)+1)/2.0::double)/count(*)-1 end p from ho a join ho b on b.i between a.i-251 and a.i group by a.date)"""
_BLEND = f"""{_PLACE},
ds as (select distinct date from bars),
rb as (select d.date, coalesce(r.vix_score,0.0) vix_score, coalesce(t.x,0.0) trend, coalesce(k.x,0.0) markov, coalesce(-h.p,0.0) put_call, coalesce(r.flow_score,0.0) flow from ds d asof left join rg r on d.date>=r.date asof left join trend t on d.date>=t.date asof left join markov k on d.date>=k.date asof left join hp h on d.date>=h.date),
blend as (select *, greatest(-1.0,least(1.0,vix_score*0.30+trend*0.20+markov*0.20+put_call*0.15+flow*0.15)) regime from rb)"""
_LINEAR = "momentum*0.15+bollinger*0.15+rsi*0.15+macd*0.12+volatility*0.20+volume*0.05+relative_strength*0.08"

_VALUES = ", ".join(f"round(coalesce({k},0.0),4)::decimal(10,4) {k}" for k in WEIGHTS)
_NAMED = lambda test: "concat_ws(', ', " + ", ".join(f"case when {k}{test} then '{k.replace('_', ' ').title()}' end" for k in WEIGHTS) + ")"
_JUDGED = f"""{FRAME}, {_PLACE}, {_FUNDAMENTALS}, {_RATINGS}, {_PEERS},
lv as (select symbol, date, close, row_number() over w data_points, {_roll('avg', 'close', 20)} sma20, {_roll('avg', 'close', 50)} sma50, {_roll('stddev_samp', 'close', 20)} sd from bars {_W}),
la as (select f.* exclude (sector_rotation, fii_fo_score, close), fii_fo_score fii_flow_score, greatest(-1.0,least(1.0,{_LINEAR})) composite_factor, lv.close, data_points, sma20, sma50, sma20+2*sd upper, sma20-2*sd lower from frame f join lv using (symbol, date) where f.date=(select max(date) from bars b where b.symbol=f.symbol)),
lb as (select la.*, hp.p fii_fo_score, valuation, financial_health, growth, analyst_consensus, sector_rotation from la asof left join hp on la.date>=hp.date left join fsc on fsc.symbol=la.symbol left join rsc on rsc.symbol=la.symbol left join psc on psc.symbol=la.symbol),
lc as (select symbol, date, close, data_points, sma20, sma50, upper, lower, {_VALUES} from lb),
ld as (select *, round(greatest(-1.0::decimal(18,8),least(1.0::decimal(18,8),{'+'.join(f'{k}*{w}::decimal(6,4)' for k, w in WEIGHTS.items())})),4)::double score, {_NAMED('>0.1')} ups, {_NAMED('<-0.1')} downs, [{', '.join(WEIGHTS)}] votes from lc),
le as (select *, case when score>=0.35 then 'BUY' when score<=-0.35 then 'SELL' else 'HOLD' end verdict, round(len(list_filter(votes, lambda x: sign(x)=sign(score)))/18.0::double*100,1) confidence from ld),
judged as (select symbol, date, data_points, score, verdict, confidence, 'linear' as method, case verdict when 'BUY' then round(case when sma20 is null then close*0.99 else greatest(least(close,(lower+sma20)/2),close*0.95) end,2) when 'SELL' then round(case when sma20 is null then close*1.01 else least(greatest(close,(upper+sma20)/2),close*1.05) end,2) else round(close,2) end as target,
 case verdict when 'BUY' then 'entry' when 'SELL' then 'exit' else 'fair_value' end as target_type, case when ups='' and downs='' then 'Signals are mixed, no strong conviction' else concat_ws(' | ', case when ups<>'' then 'Bullish: '||ups end, case when downs<>'' then 'Bearish: '||downs end) end as reasoning, sma20, sma50, upper, lower from le where data_points>=30
 union all select symbol, date, data_points, 0.0, 'INSUFFICIENT_DATA', 0.0, 'linear', null, null, 'Not enough price data', sma20, sma50, upper, lower from le where data_points<30)"""

_MODEL = """
mv0 as (select symbol, date, 1-close/lag(close,3) over (partition by symbol order by date) x from bars),
mv1 as (select symbol, date, (rank() over (partition by date order by x)+(count(*) over (partition by date, x)-1)/2.0::double)/count(*) over (partition by date) p from mv0 where x is not null),
model as (select symbol, date, case when round(p,6)>0.8 then 'LONG' when round(p,6)<0.2 then 'SHORT' else 'HOLD' end ml_verdict, round(abs(p-0.5)*200,4) ml_confidence from mv1 where date>=date '1995-01-01')"""
_LOG = f"""{FRAME}, {_MODEL},
ll as (select symbol, date, greatest(-1.0,least(1.0,{_LINEAR}))*100 composite, count(*) over (partition by symbol) n from frame),
lg as (select l.symbol, l.date, coalesce(ml_verdict, linear_signal) signal, composite, ml_confidence, linear_signal from (select *, case when composite>=40 then 'LONG' when composite<=-40 then 'SHORT' else 'HOLD' end linear_signal from ll where n>=30) l left join model using (symbol, date))"""
_QUEUE = f"""{_GATES},
q as (select g.symbol, g.date signal_date, g.date+case isodow(g.date) when 5 then 3 when 6 then 2 else 1 end::int execute_on, 'BUY' signal, b.close signal_price, f.composite, case when month(g.date)%2=0 then 'MODEL' else 'LINEAR' end source from gt g join bars b on b.symbol=g.symbol and b.date=g.date join f4 f on f.symbol=g.symbol and f.date=g.date where failed='')"""

_CURVES = f"""{FRAME}, {_MODEL}, {_BLEND},
li as (select symbol, date, close, case when {_LINEAR}>=0.2 then 1 when {_LINEAR}<=-0.2 then -1 else 0 end s from frame),
mo as (select l.symbol, l.date, l.close, case when count(m.ml_verdict) over (partition by l.symbol)>0 then case m.ml_verdict when 'LONG' then 1 when 'SHORT' then -1 else 0 end else s end s from li l left join model m using (symbol, date)),
rz as (select symbol, date, close, coalesce((close-{_roll('avg', 'close', 20, 10)})/nullif({_roll('stddev_samp', 'close', 20, 10)},0),0.0) z from bars),
rv as (select symbol, date, coalesce(last_value(case when z< -1.5 then 1 when z>=0 then 0 end ignore nulls) over (partition by symbol order by date rows unbounded preceding),0) s from rz),
ad as (select l.symbol, l.date, l.close, case when regime>0.15 then l.s when regime< -0.15 then rv.s else 0 end s from li l join rv using (symbol, date) left join blend using (date)),
al as (select 'hold' strategy, symbol, date, close, 1 s from bars union all select 'linear', * from li union all select 'model', * from mo union all select 'adaptive', * from ad),
c1 as (select *, coalesce(greatest(lag(s) over w,0),0) pos, coalesce(close/lag(close) over w-1,0.0) ret from al window w as (partition by strategy, symbol order by date)),
c2 as (select *, pos*ret-0.0015::double*abs(pos-coalesce(lag(pos) over w,0)) net from c1 window w as (partition by strategy, symbol order by date)),
c3 as (select *, exp(sum(ln(case when net>-1 then 1+net end)) over w) e, exp(sum(ln(1+ret)) over w) h from c2 window w as (partition by strategy, symbol order by date rows unbounded preceding)),
c4 as (select *, e/max(e) over (partition by strategy, symbol order by date rows unbounded preceding)-1 dd from c3)"""

_X = "(((doc_id*37)%401-200)/100.0::double)"
_REPLY = f"case when doc_id%6 not in (3,5) and {_X} between -1 and 1 then {_X} end"
_WORDS = "map {" + ", ".join(f"'{k}': {v}" for k, v in LEXICON.items()) + "}"
_SCORED = f"""
ws as (select doc_id, avg({_WORDS}[w]) p from (select doc_id, unnest(string_split_regex(lower(headline), '\\s+')) w from articles) group by doc_id),
cs as (select a.symbol, a.date, a.source, doc_id, coalesce({_REPLY}, p) score, case when {_REPLY} is not null then 'reply' when p is not null then 'lexicon' end scorer from articles a left join ws using (doc_id)),
dy as (select symbol, date, round((avg(score))::decimal(18,9),4)::double sent_score, count(*) n_articles, coalesce(string_agg(distinct nullif(source,''), ',' order by nullif(source,'')),'') sources, max(scorer) scorer from cs where score is not null group by symbol, date),
sf as (select symbol, date, round((sent_score)::decimal(18,9),4)::double sent_24h, round((avg(sent_score) over v)::decimal(18,9),4)::double sent_5d, round((sent_score-avg(sent_score) over v)::decimal(18,9),4)::double sent_momentum, round((greatest(-1.0,least(1.0,2*ln(1+sum(n_articles) over v)/ln(51.0::double)-1)))::decimal(18,9),4)::double sent_n_5d, n_articles from dy window v as (partition by symbol order by date rows 4 preceding))"""

_LEGS = {"short_call": ("CE", 0.25), "short_put": ("PE", -0.25), "long_call": ("CE", 0.10), "long_put": ("PE", -0.10)}


def _cdf(x: str) -> str:
    t = f"(1/(1+0.2316419*abs({x})))"
    tail = f"(exp(-({x})*({x})/2)/2.5066282746310002*{t}*(0.319381530+{t}*(-0.356563782+{t}*(1.781477937+{t}*(-1.821255978+{t}*1.330274429)))))"
    return f"(case when {x}>=0 then 1-{tail} else {tail} end)"


def _price(kind: str, leg: str) -> str:
    k, d1, d2 = f"{leg}_strike", f"{leg}_d1", f"({leg}_d1-{leg}_iv/100*sqrt(t))"
    paid = f"{k}*exp(-0.065::double*t)"
    return f"(spot*{_cdf(d1)}-{paid}*{_cdf(d2)})" if kind == "CE" else f"({paid}*{_cdf('(-' + d2 + ')')}-spot*{_cdf('(-' + d1 + ')')})"


_near = lambda x, kind, t: f"arg_min({x}, (abs(delta-({t}::double)), option_id)) filter (option_type='{kind}' and iv>0)"
_CONDORS = f"""
k0 as (select name, expiry, date '1995-01-10' opened, {', '.join(f'{_near("strike::double", *x)} {k}_strike, {_near("iv", *x)} {k}_iv' for k, x in _LEGS.items())} from index_chain group by name, expiry),
k1 as (select k0.*, s.close spot, greatest(date_diff('day', date '1995-01-10', expiry),1) as days, greatest(date_diff('day', date '1995-01-10', expiry),1)/365.0::double t from k0 asof left join sector_index s on s.index_name=k0.name and k0.opened>=s.date),
k2 as (select *, {', '.join(f'(ln(spot/{k}_strike)+(0.065::double+({k}_iv/100)*({k}_iv/100)/2)*t)/(({k}_iv/100)*sqrt(t)) {k}_d1' for k in _LEGS)} from k1),
k3 as (select *, {', '.join(f'{_price(kind, k)} {k}_p' for k, (kind, _) in _LEGS.items())}, case when short_call_strike is null or short_put_strike is null then 'thin' when long_call_strike<=short_call_strike or long_put_strike>=short_put_strike then 'degenerate' when spot is null then 'no_spot' else 'open' end status from k2),
k4 as (select *, short_call_p+short_put_p-long_call_p-long_put_p c, greatest(long_call_strike-short_call_strike, short_put_strike-long_put_strike) width from k3),
condors as (select name, expiry, opened, days::int as days, spot, status, {', '.join(f"case when status='open' then {k}_strike end as {k}_strike" for k in _LEGS)}, {', '.join(f"case when status='open' then round({k}_p,2) end as {k}_price" for k in _LEGS)},
 case when status='open' then round(c,2) end as credit, case when status='open' then round(c*75,0) end as credit_value, case when status='open' then round((width-c)*75,0) end as max_loss from k4),
k5 as (select c.*, s.date sd, s.close sc from condors c asof left join (select * from sector_index where date<=date '1995-04-01') s on s.index_name=c.name and c.expiry<=s.date where status='open'),
settled as (select name, expiry, opened, credit, case when ok then 'settled' else 'open' end as status, case when ok then sd end as settle_date, case when ok then sc end as settle_spot, case when ok then round(pts,2) end as points, case when ok then round(pts*75,0) end as profit
 from (select *, expiry<=date '1995-04-01' and sd is not null ok, credit-greatest(sc-short_call_strike,0)-greatest(short_put_strike-sc,0)+greatest(sc-long_call_strike,0)+greatest(long_put_strike-sc,0) pts from k5))"""
_SETTLED = "select name, expiry, opened, credit, status, settle_date, round(settle_spot,6) as settle_spot, points, profit from settled"
_due = lambda a, k, n: f"least((date_trunc('month',{a})+to_months(({k})::int))::date+({n}-1)::int, last_day((date_trunc('month',{a})+to_months(({k})::int))::date))"
_T = "date '1997-02-28'"
_TRANCHES = f"""
pl as (select sleeve, instrument, instrument*3+10 tranches, instrument%5+27 dom, case when instrument%5>0 then min(trade_date) end started, count(*) filter (side='BUY') done, coalesce(sum(qty) filter (side='BUY'),0)::double qty, sum(cast(qty*price+coalesce(fees,0) as decimal(28,6))) filter (side='BUY')::double cost from ledger group by sleeve, instrument),
ex as (select sleeve, instrument, count(*) e from pl, range(0,400) g(i) where i<tranches and started is not null and {_due('started', 'i', 'dom')}<={_T} group by all)"""

_HELD = f"""{_STOPS},
lp as (select symbol, max(date) last_date, arg_max(close,date) price, coalesce(arg_max(pc,date) filter (i>1), arg_max(close,date)) prev_close, count(*) bars from b0 group by symbol),
hv as (select e.symbol, sector, last_date, price, (e.symbol+1)*price v, (e.symbol+1)*prev_close v0, (e.symbol+1)*entry_price cost from en e join sector_of o on o.symbol=e.symbol join lp on lp.symbol=e.symbol),
ra as (select 'stop_loss' kind, 'critical' severity, s.symbol::varchar subject, close as value, stop bound, case when stop=vol_stop then 'hybrid:volatility' else 'hybrid:chandelier' end as method from s1 s join lp on lp.symbol=s.symbol and lp.last_date=s.date where close<=stop
 union all select 'circuit_breaker', 'critical', 'portfolio', x, -2.0, null from (select round(sum(v)/sum(v0)*100-100,2) x from hv) where x<=-2
 union all select 'sector_concentration', 'warning', sector, round(x,2), 25.0, null from (select sector, 100*sum(v)/sum(sum(v)) over () x from hv group by sector) where x>25),
rp as (select max(last_date) as date, count(*) as positions, round(sum(v),2) as value, round(sum(cost),2) as cost, (select count(*) from ra where severity='critical') as critical, (select count(*) from ra where severity='warning') as warnings, (select count(*)>0 from ra where kind='circuit_breaker') as halted from hv)"""

SQL = {
    # DuckDB's own skewness and kurtosis are the bias-corrected ones
    "corrected_psr": _sql("bars", f"select symbol, n, round(skew,6) as skew, round(kurt,6) as kurt, round({_cdf('z')},6) as psr from ps", """
p0 as (select symbol, close/lag(close) over (partition by symbol order by date)-1 r from bars),
p1 as (select symbol, count(r) n, avg(r)/stddev_samp(r) sr, skewness(r) skew, kurtosis(r)+3 kurt from p0 where r is not null group by symbol having count(r)>3),
ps as (select *, sr*sqrt(n-1)/sqrt(greatest(1-skew*sr+(kurt-1)/4*sr*sr, 1e-12)) z from p1)"""),
    "latest_prices": _sql("bars", "select symbol, last_date, round(price,6) as price, round(prev_close,6) as prev_close, bars from lp", _STOPS + _HELD[len(_STOPS):].split("hv as")[0].rstrip().rstrip(",")),
    "holdings_by_sector": _sql("bars sector_of", "select coalesce(sector,'TOTAL') as sector, count(*) as positions, round(sum(cost),6) as cost, round(sum(v),6) as value, round(sum(v)-sum(cost),6) as gain, round(100*(sum(v)-sum(cost))/sum(cost),6) as gain_pct from hv group by rollup(sector)", _HELD),
    "risk_alerts": _sql("bars sector_of", "select kind, severity, subject, round(value,6) as value, round(bound,6) as bound, method from ra", _HELD),
    "daily_report": _sql("bars sector_of", """select date, positions, value, cost, critical, warnings, halted, round(value-cost,2) as gain, '{"date":"'||date||'","positions":'||positions||',"critical":'||critical||',"warnings":'||warnings||',"halted":'||halted||'}' as document from rp""", _HELD),
    "fundamental_scores": _sql("financials", "select symbol, round(valuation,6) as valuation, round(financial_health,6) as financial_health, round(growth,6) as growth from fsc", _FUNDAMENTALS),
    "analyst_consensus": _sql("ratings", "select symbol, round(analyst_consensus,6) as analyst_consensus from rsc", _RATINGS),
    "peer_rotation": _sql("bars bench sector_of", "select symbol, round(sector_rotation,6) as sector_rotation from psc", _PEERS),
    "index_reversion": _sql("sector_index", f"""select symbol, date, round(z20,6) as z20, round(z50,6) as z50, round(band,6) as band, round(rsi,6) as rsi, round(b,6) as blend, round(least(abs(b),1.0),6) as strength,
 case when b< -0.3 and rsi<35 then 'OVERSOLD_BUY' when b>0.3 and rsi>65 then 'OVERBOUGHT_SELL' when b< -0.15 then 'MILD_OVERSOLD' when b>0.15 then 'MILD_OVERBOUGHT' else 'NEUTRAL' end as signal from (select *, (z20*0.6+z50*0.4)/2*0.4+(band-0.5)*2*0.3+(rsi-50)/50*0.3 b from x2) where n>=50""", f"""
x0 as (select index_name symbol, date, close, close-lag(close) over (partition by index_name order by date) d, row_number() over (partition by index_name order by date) n from sector_index),
x1 as (select *, {_roll('avg', 'close', 20)} a, {_roll('stddev_samp', 'close', 20)} s, {_roll('avg', 'close', 50)} a5, {_roll('stddev_samp', 'close', 50)} s5, {_roll('avg', '(case when d is not null then greatest(d,0) end)', 14)} g, {_roll('avg', '(case when d is not null then greatest(-d,0) end)', 14)} l from x0),
x2 as (select *, case when s>0 then (close-a)/s else 0.0 end z20, case when s5>0 then (close-a5)/s5 else 0.0 end z50, case when s>0 then (close-a+2*s)/(4*s) else 0.5 end band, 100-100/(1+case when l=0 then 100.0 else g/l end) rsi from x1)"""),
    "regime_blend": _sql("bars bench market_regime sector_index delivery", "select date, round(vix_score,6) as vix_score, round(trend,6) as trend, round(markov,6) as markov, round(put_call,6) as put_call, round(flow,6) as flow, round(regime,6) as regime from blend", MARKET + "," + _BLEND),
    "latest_market_scores": _sql("bars bench market_regime sector_index delivery", "select date, round(vix_score,6) as vix_score, round(trend,6) as trend, round(markov,6) as markov, round(put_call,6) as put_call, round(flow,6) as flow, round(regime,6) as regime from blend where date=(select max(date) from blend)", MARKET + "," + _BLEND),
    "verdicts": _sql(TABLES + " financials ratings", "select symbol, date, data_points, score, verdict, confidence, method, target, target_type, reasoning, round(sma20,6) as sma20, round(sma50,6) as sma50, round(upper,6) as upper, round(lower,6) as lower from judged", _JUDGED),
    "verdict_ranking": _sql(TABLES + " financials ratings", "select row_number() over (order by score desc, symbol) as rank, symbol, score, verdict, count(*) over (partition by verdict) as same_verdict from judged", _JUDGED),
    "signals_backfill": _sql(TABLES, "select symbol, date, signal, round(composite,6) as composite, ml_confidence, linear_signal from lg", _LOG),
    "signals_log": _sql(TABLES, """select symbol, date, case when n is not null then n else o end as signal, round(case when n is not null then nc else 0.0 end,6) as composite, case when n is not null then nm else om end as ml_confidence, case when n is not null then nl else ol end as linear_signal, note
 from (select symbol, date, g.signal n, g.composite nc, g.ml_confidence nm, g.linear_signal nl, l.* exclude (symbol, date) from lg g full join ol l using (symbol, date)) where case when n is not null then nm is not null or nl is not null else om is not null or ol is not null end""", _LOG + """,
ol as (select symbol, date, 'HOLD' o, case when day(date)%7<>0 then 50.0 end om, case when day(date)%7<>0 then 'HOLD' end ol, 'n'||symbol note from bars where symbol%2=1)"""),
    "signal_queue": _sql("bars", "select symbol, signal_date, execute_on, signal, round(signal_price,6) as signal_price, round(composite,6) as composite, source, 'pending' as status from q", _QUEUE),
    "signal_skips": _sql("bars", "select symbol, date, gate, case gate when 'composite' then '>= 40' when 'linear_agreement' then 'LONG' when 'ml_confidence' then '>= 40' when 'meta_labeler' then '>= 0.75' when 'liquidity_adv' then '>= 500000' else '>= 200' end as required from (select symbol, date, unnest(string_split(failed, ',')) gate from gt where failed<>'')", _GATES),
    "gap_checks": _sql("bars", """select symbol, signal_date, execute_on, signal, round(signal_price,6) as signal_price, round(composite,6) as composite, source, case when price is null then 'rejected_risk' when wide then 'rejected_gap' else 'pending' end as status, round(price,6) as price,
 case when price is null then 'no_current_price' when wide then 'gap '||printf('%.2f', gap)||'% exceeds 3% limit' end as reason, gap as gap_pct from (select q.*, b.close price, round(abs((b.close-signal_price)/signal_price)*100,2) gap, abs(b.close-signal_price)*100>3*signal_price wide from q asof left join bars b on b.symbol=q.symbol and q.execute_on>=b.date)""", _QUEUE),
    "strategies": _sql(TABLES, "select strategy, symbol, count(*) as bars, sum(pos)::bigint as held, case when min(net)>-1 then round(ln(arg_max(e,date)),6) end as log_ret, round(ln(arg_max(h,date)),6) as hold_log_ret, case when min(net)>-1 then round(min(dd),6) else -1.0 end as max_drawdown from c4 group by strategy, symbol", _CURVES),
    "reply_scores": _sql("articles", f"select doc_id, {_REPLY} as score from articles"),
    "batch_reply_scores": _sql("articles", "select symbol, date, (row_number() over (partition by symbol, date order by doc_id)-1)::int as i, case when doc_id%5<>0 and doc_id%7<>0 then (doc_id%21-10)/10.0::double end as score from articles"),
    "chain_scores": _sql("articles", "select doc_id, round(score,6) as score, scorer from cs", _SCORED),
    "news_sentiment": _sql("articles", "select symbol, date, round(avg(p),6) as sent_score, count(p) as n_articles, coalesce(string_agg(distinct case when p is not null then source end, ',' order by case when p is not null then source end),'') as sources from nb group by symbol, date", _SCORED + """,
na as (select symbol, min(doc_id) doc_id from articles group by symbol, headline),
nb as (select a.symbol, a.date, a.source, p from articles a join na on na.symbol=a.symbol and na.doc_id=a.doc_id left join ws on ws.doc_id=a.doc_id)"""),
    "sentiment_daily": _sql("articles", "select symbol, date, sent_score, n_articles, sources, scorer from dy", _SCORED),
    "sentiment_features": _sql("articles", "select * from sf", _SCORED),
    "sentiment_factor": _sql("articles", "select n_nationkey as symbol, coalesce(arg_max(sent_24h,date),0.0) as sentiment, max(date) as last_date from nation left join sf on symbol=n_nationkey group by n_nationkey", _SCORED),
    "sentiment_summary": _sql("articles", """select n_nationkey as symbol, coalesce(articles,0) as articles, coalesce(scored,0) as scored, coalesce(days,0) as days, first_date, last_date, case when coalesce(articles,0)=0 then 'no_articles' when coalesce(days,0)=0 then 'no_scores' else 'ok' end as status
 from nation left join (select symbol, count(*) articles, count(score) scored from cs group by symbol) a on a.symbol=n_nationkey left join (select symbol, count(*) as days, min(date) first_date, max(date) last_date from dy group by symbol) d on d.symbol=n_nationkey""", _SCORED),
    "newest_articles": _sql("articles", "select * from (select symbol, date, source, doc_id, row_number() over (partition by symbol order by date desc, doc_id desc) as place from articles) where place<=5"),
    "option_condors": _sql("index_chain sector_index", "select * replace (round(spot,6) as spot) from condors", _CONDORS),
    "condors_settled": _sql("index_chain sector_index", _SETTLED, _CONDORS),
    "condor_totals": _sql("index_chain sector_index", "select coalesce(name,'TOTAL') as name, count(*) as positions, count(*) filter (status='settled') as settled, count(*) filter (profit>0) as winners, coalesce(sum(profit),0.0) as profit from settled group by rollup(name)", _CONDORS),
    "tranche_status": _sql("ledger", f"""select sleeve, instrument, tranches, done, done>=tranches as complete, qty, round(case when qty>0 then cost/qty end,6) as avg_entry, started, coalesce(e,0) as expected, greatest(0,coalesce(e,0)-case when started is null then 0 else done end) as overdue,
 case when done<tranches then case when started is not null then {_due('started', 'done', 'dom')} when {_due(_T, '0', 'dom')}<{_T} then {_due(_T, '1', 'dom')} else {_due(_T, '0', 'dom')} end end as next_due from pl left join ex using (sleeve, instrument)""", _TRANCHES),
}
