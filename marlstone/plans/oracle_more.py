"""DuckDB's SQL for the queries on histories and signals, written from the definitions."""

from __future__ import annotations

from marlstone.plans.oracle import _clip, _roll, _sql

_W = "window w as (partition by symbol order by date)"
_FORMATS = "case o_orderkey%4 when 0 then strftime(o_orderdate,'%Y-%m-%d') when 1 then strftime(o_orderdate,'%d-%b-%Y') when 2 then strftime(o_orderdate,'%d/%m/%Y') else strftime(o_orderdate,'%b %-d, %Y') end"
_REV = f"rv as (select symbol, date, 1-close/lag(close,3) over w rev3 from bars {_W})"
_R1 = f"r1 as (select symbol, date, close, close/lag(close) over w-1 r from bars {_W})"
_RANK = "rank() over (partition by {by} order by {x})+(count(*) over (partition by {by}, {x})-1)/2.0::double"
_NORM = "(case when {z}>=0 then 1-{t} else {t} end)"

SQL = {
    "latest_bars": _sql("bars", "select symbol, date, close from (select *, row_number() over (partition by symbol order by date desc) rn from bars) where rn<=30"),
    "bars_between": _sql("bars", "select symbol, date, close, volume from bars where date between date '1995-01-01' and date '1996-12-31'"),
    "universe": _sql("bars", "select distinct symbol from bars where symbol not in (0,7)"),
    "benchmark_fallback": _sql("bench sector_index", "select date, close, source from x where source=(select min(source) from x)", "x as (select date, close, 1 source from sector_index where index_name='ASIA' and date>=date '1995-01-01' union all select date, close, 2 from bench)"),
    "replace_range": _sql("bars", "select symbol, date, close from bars b where not exists (select 1 from s where s.symbol=b.symbol and b.date between a and z) union all select symbol, date, close from nw", "nw as (select symbol, date, close+1 as close from bars where symbol<5 and date between date '1995-03-01' and date '1995-06-30' and day(date)%2=0), s as (select symbol, min(date) a, max(date) z from nw group by symbol)"),
    "overwrite_guard": _sql("bars", "select symbol, count(*) n from bars group by symbol having count(*)>=100"),
    "fill_where_null": _sql("market_regime bench", "select m.date, coalesce(case when fo_net_long>0 then vix end, b.close/100) vix from market_regime m left join bench b on b.date=m.date"),
    "cross_validated_fill": _sql("bench", "select date, close from f union all select s.date, s.close from s, g where ok and s.date not in (select date from f)", "f as (select * from bench where date<date '1997-01-01'), s as (select date, close*1.001 as close from bench), g as (select count(*)>=100 and quantile_cont(abs(s.close/f.close-1),0.5)<=0.02 ok from f join s using (date))").replace("select s.date, s.close from s, g", "select s.date, round(s.close,6) from s, g"),
    "missing_windows": _sql("bars", "select * from (select symbol, 'older' side, date '1990-01-01' a, cast(min(date)-1 as date) b from bars group by symbol union all select symbol, 'newer', cast(max(date)+1 as date), date '2001-12-31' from bars group by symbol) where a<=b"),
    "gap_fill_plan": _sql("bars", "select symbol, date from (select symbol, cast(unnest(generate_series(hi+interval 1 day, least(timestamp '2001-12-31', hi+interval 30 day), interval 1 day)) as date) date from (select symbol, max(date) hi from bars group by symbol) where hi<date '2001-12-31') where isodow(date)<=5"),
    "cadence_mask": _sql("bars", "select symbol, date, gap, m median_gap, coalesce(m<=1.6,false) daily from (select *, case when count(gap) over f>=5 then quantile_cont(gap,0.5) over f end m from g window f as (partition by symbol order by date rows between 9 preceding and current row))", f"g as (select symbol, date, date_diff('day', lag(date) over w, date) gap from bars {_W})"),
    "history_counts": _sql("bars", "select symbol, count(*) n, count(*)>=30 scored, count(*)>=120 trained, count(*)>=252 tested from bars group by symbol"),
    "identity_lock": _sql("ledger", "select instrument, count(*) n, max(maker) maker from (select *, first_value(maker) over (partition by instrument order by trade_date, id, line, supp) f from lk) where maker='' or maker=f group by instrument", "lk as (select *, case when line=7 then '' else cast(supp as varchar) end maker from ledger)"),
    "adjusted_closes": _sql("bars", "select symbol, date, round(f,6) factor, round(close/f,6) adjusted from (select b.symbol, b.date, close, (select round(exp(coalesce(sum(ln(ratio)),0.0)),9) from act a where a.symbol=b.symbol and a.date>b.date) f from bars b)", "act as (select symbol, min(date)+1 date, 1.7::double ratio from bars where year(date)>1992 group by symbol, year(date))"),
    "latest_change": _sql("bars", "select symbol, date, close, round(p,6) previous, round((close/p-1)*100,6) pct from l where rn=1 and p>0", "l as (select *, lag(close) over (partition by symbol order by date) p, row_number() over (partition by symbol order by date desc) rn from bars)"),
    "sector_momentum": _sql("bars", "select n_regionkey sector, round(avg((close/p-1)*100),6) avg_pct, count(*) n from l join nation on n_nationkey=symbol where rn=1 and p>0 group by n_regionkey", "l as (select *, lag(close) over (partition by symbol order by date) p, row_number() over (partition by symbol order by date desc) rn from bars)"),
    "movers": _sql("bars", "(select symbol, round(pct,6) pct, 'gainer' side from c order by c.pct desc, symbol limit 5) union all (select symbol, round(pct,6), 'loser' from c order by c.pct, symbol limit 5)", "l as (select *, lag(close) over (partition by symbol order by date) p, row_number() over (partition by symbol order by date desc) rn from bars), c as (select symbol, (close/p-1)*100 pct from l where rn=1 and p>0)"),
    "close_on_or_after": _sql("bench", "select day, b.date, b.close from (select d.day, min(b.date) date from d join bench b on b.date between d.day and d.day+10 group by d.day) join bench b using (date)", "d as (select distinct last_day(date) as day from bench)"),
    "ledger_last_dates": _sql("ledger", "select instrument, max(case when side='BUY' then trade_date end) last_date from ledger group by instrument"),
    "ever_members": _sql("spells", "select distinct index_name, symbol from spells"),
    "registry_diff": _sql("spells", "select coalesce(a.index_name,b.index_name) index_name, coalesce(a.symbol,b.symbol) symbol, case when a.symbol is null then 'joined' else 'left' end change from a full join b on a.index_name=b.index_name and a.symbol=b.symbol where a.symbol is null or b.symbol is null", "a as (select distinct index_name, symbol from spells where effective_from<=date '1993-03-31' and (effective_to is null or effective_to>=date '1993-03-31')), b as (select distinct index_name, symbol from spells where effective_from<=date '1998-03-31' and (effective_to is null or effective_to>=date '1998-03-31'))"),
    "membership_summary": _sql("spells", "select index_name, count(*) spells, count(distinct symbol) symbols, count(*) filter (effective_to is null) \"current\", min(effective_from) first_day from spells group by index_name"),
    "parsed_dates": "select o_orderkey, cast(o_orderdate as date) as date from orders",
    "parsed_numbers": "select o_orderkey, case when o_orderkey%5=0 then null else round(cast(o_totalprice as double),2) end as amount from orders",
    "parsed_deliveries": "select s_name as name, count(*) n, cast(sum(cast(l_quantity as bigint)) as bigint) traded, cast(sum(case when l_linestatus='F' then cast(l_quantity as bigint) else 0 end) as bigint) delivered from lineitem join supplier on l_suppkey=s_suppkey where l_linenumber<>7 and l_returnflag<>'R' group by s_name",
    "rolling_median": _sql("bars", "select symbol, date, round(case when count(*) over f>=10 then quantile_cont(close,0.5) over f end,6) median from bars window f as (partition by symbol order by date rows between 9 preceding and current row)"),
    "rsi_simple": _sql("bars", f"select symbol, date, round(100-100/(1+case when l=0 then 100.0 else g/l end),6) rsi from (select symbol, date, {_roll('avg', 'gain', 14)} g, {_roll('avg', 'loss', 14)} l from d)", f"d0 as (select symbol, date, close-lag(close) over w d from bars {_W}), d as (select symbol, date, case when d>0 then d when d<=0 then 0 end gain, case when d<0 then -d when d>=0 then 0 end loss from d0)"),
    "bar_context": _sql("bars", f"select symbol, date, row_number() over w bar, date_diff('day', lag(date) over w, date) gap, round(max(high) over (partition by symbol order by date rows between 21 preceding and current row),6) highest from bars {_W}"),
    "sma_crosses": _sql("bars", "select symbol, date, case when pa<=pb and a>b then 'golden' else 'death' end \"cross\" from p where (pa<=pb and a>b) or (pa>=pb and a<b)", f"s as (select symbol, date, {_roll('avg', 'close', 20)} a, {_roll('avg', 'close', 50)} b from bars), p as (select *, lag(a) over w pa, lag(b) over w pb from s {_W})"),
    "trend_factors": _sql("bars", f"select symbol, date, case when close>s20 then 0.25 else -0.25 end::double+case when close>s50 then 0.25 else -0.25 end::double+case when s20>s50 then 0.5 else -0.5 end::double trend, round({_clip('-z50/2', -1.0, 1.0)},6) reversion, round(0.6*{_clip('r63/0.3', -1.0, 1.0)}+0.4*{_clip('-z20/2', -1.0, 1.0)},6) simple_composite from t", f"t as (select symbol, date, close, {_roll('avg', 'close', 20)} s20, {_roll('avg', 'close', 50)} s50, (close-{_roll('avg', 'close', 20)})/nullif({_roll('stddev_samp', 'close', 20)},0) z20, (close-{_roll('avg', 'close', 50)})/nullif({_roll('stddev_samp', 'close', 50)},0) z50, close/lag(close,63) over w-1 r63 from bars {_W})"),
    "put_call_ratio": _sql("option_chain", "select name, put_oi, call_oi, round(put_oi/nullif(call_oi,0)::double,6) pcr from (select name, cast(coalesce(sum(oi) filter (option_type='PE'),0) as bigint) put_oi, cast(coalesce(sum(oi) filter (option_type='CE'),0) as bigint) call_oi from option_chain group by name)"),
    "every_kth": _sql("bars", "select symbol, date, close from (select *, row_number() over (partition by symbol order by date)-1 o from bars) where o%21=0"),
    "cohorts": _sql("bars", "select symbol, date, o bar from (select *, row_number() over (partition by symbol order by date)-1 o from bars) where o>=30 and (o-30)%5=0"),
    "day_buckets": _sql("ticks", "select symbol, day, n, cast(day + (case isodow(day) when 5 then 3 when 6 then 2 else 1 end)::int as date) next_day from (select symbol, cast(ts as date) as day, count(*) n from ticks group by 1, 2)"),
    "deal_profile": _sql("deals", "select symbol, date, round(v,6) vwap, round(c,6) concentration, round(t/v-1,6) deviation from (select symbol, date, sum(price*quantity)/sum(quantity) v, max(quantity)/sum(quantity) c, max(price) t from deals group by symbol, date)"),
    "volume_against_prior": _sql("bars", f"select symbol, date, round({_clip('volume/nullif(m,0)', 0.0, 10.0)},6) spike from (select *, case when count(*) over f>=5 then avg(volume) over f end m from bars window f as (partition by symbol order by date rows between 20 preceding and 1 preceding))"),
    "ic_decay": _sql("bars", "select h horizon, count(*) dates, round(avg(ic),6) mean_ic, round(avg(case when ic>1e-9 then 1.0 else 0.0 end),6) positive from ic where ic is not null group by h", f"x as (select symbol, date, 1-close/lag(close,3) over w score, lead(close,1) over w/close-1 f1, lead(close,5) over w/close-1 f5, lead(close,10) over w/close-1 f10, lead(close,20) over w/close-1 f20 from bars {_W}), l as (select date, score, 1 h, f1 fwd from x union all select date, score, 5, f5 from x union all select date, score, 10, f10 from x union all select date, score, 20, f20 from x), k as (select h, date, {_RANK.format(by='h, date', x='score')} a, {_RANK.format(by='h, date', x='fwd')} b from l where score is not null and fwd is not null), ic as (select h, date, case when stddev_pop(a)>1e-12 and stddev_pop(b)>1e-12 then corr(a,b) end ic from k group by h, date having count(*)>=5)"),
    "pooled_metrics": _sql("bars", "select count(*) n, round(corr(s,f),6) pearson, round(avg(case when s<>0 and f<>0 then case when sign(s)=sign(f) then 1.0 else 0.0 end end),6) hit_rate from x where s is not null and f is not null", f"x as (select 1-close/lag(close,3) over w s, lead(close,20) over w/close-1 f from bars {_W})"),
    "cs_percentile": _sql("bars", f"select symbol, date, round(({_RANK.format(by='date', x='rev3')})/count(*) over (partition by date),6) pct from rv where rev3 is not null", _REV),
    "profit_labels": _sql("bars", f"select symbol, date, case when f is not null then cast(f>0 as int) end label from (select symbol, date, lead(close,20) over w/close-1 f from bars {_W})"),
    "time_groups": _sql("bench", "select date, cast(g as int) \"group\" from (select date, row_number() over (order by date)-1 o, count(*) over () n from bench), (select unnest(range(6)) g) where o>=floor(g*n/6) and o<floor((g+1)*n/6)").replace("floor(g*n/6)", "(g*n)//6").replace("floor((g+1)*n/6)", "((g+1)*n)//6"),
    "sharpe": _sql("bars", "select symbol, count(*) n, round(case when count(*)>=20 and stddev_samp(r)>0 then avg(r)/stddev_samp(r)*sqrt(252) end,6) sharpe from r1 where r is not null group by symbol", _R1),
    "market_fit": _sql("bars bench", "select symbol, count(*) n, round(regr_slope(r,m),6) beta, round(regr_intercept(r,m),6) alpha, round(avg(r) filter (m>0)/avg(m) filter (m>0),6) up_capture, round(avg(r) filter (m<0)/avg(m) filter (m<0),6) down_capture from r1 join (select date, close/lag(close) over (order by date)-1 m from bench) using (date) where r is not null and m is not null group by symbol", _R1),
    "year_returns": _sql("bars", "select symbol, cast(year(date) as int) as year, round(exp(sum(ln(1+r)))-1,6) ret from r1 where r is not null group by symbol, year(date)", _R1),
    "delivery_spikes": _sql("settled bars", "select symbol, date, round(z,6) z, round(r,6) r, case when r>0 then 'UP' else 'DOWN' end side from dz join r1 using (symbol, date) where z>2 and abs(r)>=0.01", f"dz as (select symbol, date, (delivery_pct-{_roll('avg', 'delivery_pct', 60, 30)})/nullif({_roll('stddev_samp', 'delivery_pct', 60, 30)},0) z from settled), {_R1}"),
    "max_orders": _sql("bars", "select symbol, cast(least(a,b) as bigint) shares, case when a<=b then 'value' else 'volume' end bound from (select symbol, floor(100000.0/close) a, floor(volume*0.03::double) b from (select *, row_number() over (partition by symbol order by date desc) rn from bars) where rn=1)"),
    "price_alerts": _sql("bars", "select symbol, round(t,6) threshold, round(p,6) price, d direction, case when d='above' then p>=t else p<=t end triggered from (select symbol, avg(close) t, max_by(close,date) p, case when symbol%2=0 then 'above' else 'below' end d from bars group by symbol)"),
    "circuit_breaker": _sql("bars", "select date, round(c,6) change, round(c,9)<=-0.02 stop from (select date, sum(close)/sum(p)-1 c from (select date, close, lag(close) over (partition by symbol order by date) p from bars) where p is not null group by date)"),
    "holdings": _sql("ledger", "select coalesce(sleeve,'TOTAL') sleeve, cast(sum(q) as double) qty, round(sum(q*p),6) \"value\", count(*) instruments from h group by rollup(sleeve)", "h as (select sleeve, instrument, sum(case when side='BUY' then qty else -qty end) q, arg_max(price, (trade_date,id,line,supp)) p from ledger group by sleeve, instrument)"),
    "chain_status": _sql("option_chain", "select name, count(*) quotes, count(distinct expiry_id) expiries, min(iv) least_iv, max(iv) most_iv from option_chain group by name"),
    "parsed_price_files": _sql("bars", "select cast(symbol as varchar) as symbol, date, open, high, low, close, cast(null as double) as prev_close, volume, 'I'||symbol as isin from bars where symbol%7<>3"),
    "parsed_open_interest": _sql("market_regime", "select date, cast(fo_net_long as double) as net from market_regime"),
    "parsed_flow_files": _sql("market_regime", "select date, round(flow,2) as fii, case when day(date)%5=0 then null else cast(fo_net_long as double) end as dii from market_regime"),
    "parsed_filings": _sql("filings", "select cast(symbol as varchar) as symbol, ts, case when period%2=0 then date_trunc('month', cast(ts as date))::date end as period_start, last_day(cast(ts as date)) as period_end, cast(period as varchar) as seq_number from filings"),
    "parsed_put_calls": _sql("market_regime", "select date, v as pcr from (select date, fo_net_long::double v, day(date)%4 k from market_regime) where k=0 or v<>0"),
}
