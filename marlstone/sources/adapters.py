"""Logical market tables derived from the star-schema tables. Each is one SQL text; ``{name}`` stands for an input table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "bars": """
with t as (select s.s_nationkey as symbol, cast(l.l_shipdate as date) as date, l.l_extendedprice/l.l_quantity as px, l.l_quantity as q,
 row_number() over (partition by s.s_nationkey, cast(l.l_shipdate as date) order by l.l_orderkey,l.l_linenumber,l.l_partkey,l.l_suppkey,l.l_extendedprice) as rn,
 row_number() over (partition by s.s_nationkey, cast(l.l_shipdate as date) order by l.l_orderkey desc,l.l_linenumber desc,l.l_partkey desc,l.l_suppkey desc,l.l_extendedprice desc) as rd
 from {lineitem} l join {supplier} s on l.l_suppkey=s.s_suppkey)
select symbol, date, max(case when rn=1 then px end) as open, max(px) as high, min(px) as low, max(case when rd=1 then px end) as close, cast(sum(q) as bigint) as volume from t group by symbol, date""",
    "bench": """
select cast(l_shipdate as date) as date, cast(sum(cast(l_extendedprice as decimal(18,2))) as double)/cast(sum(cast(l_quantity as decimal(18,2))) as double) as close
 from {lineitem} group by cast(l_shipdate as date)""",
    "sector_index": """
select r.r_name as index_name, cast(l.l_shipdate as date) as date, cast(sum(cast(l.l_extendedprice as decimal(18,2))) as double)/cast(sum(cast(l.l_quantity as decimal(18,2))) as double) as close
 from {lineitem} l join {supplier} s on l.l_suppkey=s.s_suppkey join {nation} n on s.s_nationkey=n.n_nationkey join {region} r on n.n_regionkey=r.r_regionkey group by r.r_name, cast(l.l_shipdate as date)""",
    "market_regime": """
select cast(o_orderdate as date) as date, cast(sum(cast(o_totalprice as decimal(18,2))) as double)/count(*)/10000 as vix,
 cast(sum(case when o_orderstatus='F' then cast(o_totalprice as decimal(18,2)) when o_orderstatus='O' then -cast(o_totalprice as decimal(18,2)) else 0 end) as double) as flow,
 cast(sum(case when o_orderpriority like '1%' then 1 when o_orderpriority like '5%' then -1 else 0 end) as bigint) as fo_net_long from {orders} group by cast(o_orderdate as date)""",
    "delivery": """
select s.s_nationkey as symbol, cast(l.l_shipdate as date) as date, cast(sum(l.l_quantity) as bigint) as traded_qty,
 cast(sum(case when l.l_linestatus='F' then l.l_quantity else 0 end) as bigint) as delivery_qty,
 100*sum(case when l.l_linestatus='F' then l.l_quantity else 0 end)/sum(l.l_quantity) as delivery_pct
 from {lineitem} l join {supplier} s on l.l_suppkey=s.s_suppkey group by s.s_nationkey, cast(l.l_shipdate as date)""",
    "settled": """
select s.s_nationkey as symbol, cast(l.l_shipdate as date) as date,
 100*cast(sum(case when l.l_returnflag='A' then l.l_quantity else 0 end) as double)/cast(sum(l.l_quantity) as double) as delivery_pct
 from {lineitem} l join {supplier} s on l.l_suppkey=s.s_suppkey group by s.s_nationkey, cast(l.l_shipdate as date)""",
    "deals": """
select cast(l.l_shipdate as date) as date, s.s_nationkey as symbol, s.s_name as client_name,
 case when l.l_returnflag='R' then 'SELL' when l.l_returnflag='A' then 'BUY' else 'OTHER' end as trade_type,
 l.l_quantity as quantity, l.l_extendedprice/l.l_quantity as price, case when l.l_linestatus='O' then 'BULK' else 'BLOCK' end as deal_type
 from {lineitem} l join {supplier} s on l.l_suppkey=s.s_suppkey""",
    "membership": """
select o_orderpriority as index_name, c_nationkey as symbol, cast(min(o_orderdate) as date) as effective_from,
 case when c_nationkey%5=0 then null else cast(max(o_orderdate) as date) end as effective_to
 from {orders} join {customer} on o_custkey=c_custkey where o_orderkey%7=c_nationkey%7 and o_orderdate>=timestamp '1996-01-01 00:00:00' and o_orderdate<timestamp '1999-07-01 00:00:00' group by o_orderpriority, c_nationkey""",
    "ticks": """
select event_type as symbol, ts, value as price, event_id from {events} where value>0""",
    "ledger": """
select r.r_name as sleeve, l.l_partkey%50 as instrument, cast(l.l_shipdate as date) as trade_date, case when l.l_linestatus='O' then 'BUY' else 'SELL' end as side,
 l.l_quantity as qty, l.l_extendedprice/l.l_quantity as price, l.l_tax as fees, l.l_orderkey as id, l.l_linenumber as line, l.l_suppkey as supp
 from {lineitem} l join {supplier} s on l.l_suppkey=s.s_suppkey join {nation} n on s.s_nationkey=n.n_nationkey join {region} r on n.n_regionkey=r.r_regionkey""",
    "option_chain": """
select p_brand as name, p_partkey%40 as expiry_id, p_partkey as option_id, p_retailprice as strike, case when p_size%2=0 then 'CE' else 'PE' end as option_type,
 10+cast(p_size as double)/5 as iv, case when p_size%2=0 then cast(p_size as double)/51 else -cast(p_size as double)/51 end as delta, cast(p_partkey*37%1000 as bigint) as oi from {part}""",
    "fundamentals": """
select p_partkey as symbol, p_type as industry, p_retailprice/p_size as pe_ratio, cast(p_size as double)/10 as pb_ratio, cast(p_partkey%300 as double)/100 as debt_to_equity, cast(p_partkey%400 as double)/100 as current_ratio from {part}""",
    "news": """
select doc_id%25 as symbol, cast(date '2024-01-01' + cast(doc_id%30 as int) as date) as date, source, substr(text,1,80) as headline, doc_id from {documents}""",
    # whole inputs: membership and news, which some SQL texts still read, leave out orders and all of a text but 80 characters
    "spells": """
with m as (select distinct o_orderpriority as index_name, c_nationkey as symbol, year(o_orderdate)*12+month(o_orderdate) as k, cast(date_trunc('month',o_orderdate) as date) as first
 from {orders} join {customer} on o_custkey=c_custkey),
g as (select *, k-row_number() over (partition by index_name, symbol order by k) as island from m)
select index_name, symbol, min(first) as effective_from, case when max(k)=(select max(k) from m) then null else last_day(max(first)) end as effective_to from g group by index_name, symbol, island""",
    # spells as several registers of one kind have them: they overlap, and some repeat a start
    "register": """
select o_orderpriority as index_name, c_nationkey as symbol, cast(date_trunc('month',min(o_orderdate)) as date) as effective_from,
 case when c_nationkey%5=0 then null else cast(max(o_orderdate) as date) end as effective_to
 from {orders} join {customer} on o_custkey=c_custkey group by o_orderpriority, c_nationkey, c_mktsegment, year(o_orderdate)""",
    # candles of a quarter of an hour; line items are dealt over five of a session's, 9:15 to 15:15
    "sessions": """
with t as (select s.s_nationkey as symbol, cast(l.l_shipdate as date) as date, (l.l_orderkey*7+l.l_linenumber)%5 as slot, l.l_extendedprice/l.l_quantity as px, l.l_quantity as q,
 row_number() over (partition by s.s_nationkey, cast(l.l_shipdate as date), (l.l_orderkey*7+l.l_linenumber)%5 order by l.l_orderkey,l.l_linenumber,l.l_partkey,l.l_suppkey,l.l_extendedprice) as rn,
 row_number() over (partition by s.s_nationkey, cast(l.l_shipdate as date), (l.l_orderkey*7+l.l_linenumber)%5 order by l.l_orderkey desc,l.l_linenumber desc,l.l_partkey desc,l.l_suppkey desc,l.l_extendedprice desc) as rd
 from {lineitem} l join {supplier} s on l.l_suppkey=s.s_suppkey)
select symbol, date, case slot when 0 then 555 when 1 then 570 when 2 then 720 when 3 then 855 else 915 end as minute, max(case when rn=1 then px end) as open, max(px) as high, min(px) as low, max(case when rd=1 then px end) as close, cast(sum(q) as bigint) as volume from t group by symbol, date, slot""",
    "filings": """
select c_nationkey as symbol, year(o_orderdate)*10+quarter(o_orderdate) as period, o_orderdate + interval '1' minute * (o_orderkey%1440) as ts
 from {orders} join {customer} on o_custkey=c_custkey where o_orderpriority='1-URGENT'""",
    "fund_prices": """
select l_partkey%50 as instrument, cast(l_shipdate as date) as date, cast(sum(cast(l_extendedprice as decimal(18,2))) as double)/cast(sum(cast(l_quantity as decimal(18,2))) as double) as close
 from {lineitem} where l_returnflag='A' group by l_partkey%50, cast(l_shipdate as date)""",
    "sector_of": """
select n.n_nationkey as symbol, r.r_name as sector from {nation} n join {region} r on n.n_regionkey=r.r_regionkey""",
    "financials": """
select p_partkey as symbol, p_retailprice/p_size as pe_ratio, cast(p_size as double)/10 as pb_ratio, cast(p_partkey%90 as double)/10 as price_to_sales, cast(p_partkey%400 as double)/100 as current_ratio,
 cast(p_partkey%300 as double)/100 as debt_to_equity, case when p_partkey%5>0 then cast(p_partkey%70 as double)/10 end as interest_coverage, p_retailprice-1200 as free_cash_flow,
 cast(p_partkey%40-10 as double) as revenue_growth_5y, case when p_partkey%3>0 then cast(p_partkey%31-12 as double) end as eps_growth_5y, cast(p_size-20 as double) as revenue_growth_3y, cast(p_size%17-5 as double) as eps_growth_3y,
 cast(p_partkey%23-3 as double) as net_margin_ttm, cast(p_partkey%11-2 as double) as net_margin_5y from {part}""",
    "ratings": """
select p_partkey as symbol, p_size%5 as strong_buy, p_size%7 as buy, case when p_size%3=0 then null else p_size%4 end as hold, cast(p_partkey%3 as int) as sell, cast(p_partkey%2 as int) as strong_sell from {part}""",
    # options on the sector indexes, whose strikes fall with a call's delta and rise with a put's
    "index_chain": """
select r_name as name, cast(date '1995-01-20' + cast(p_partkey%4*28 as int) as date) as expiry, p_partkey as option_id, case when p_size%2=0 then 'CE' else 'PE' end as option_type,
 1500+case when p_size%2=0 then 1 else -1 end*(51-p_size)*8.0+p_partkey%7 as strike, 10+cast(p_size as double)/5 as iv, case when p_size%2=0 then cast(p_size as double)/51 else -cast(p_size as double)/51 end as delta from {part} join {region} on r_regionkey=p_partkey%5""",
    "articles": """
select doc_id%25 as symbol, cast(date '2024-01-01' + cast(doc_id%30 as int) as date) as date, source, text as headline, doc_id from {documents}""",
}

_FIRST = "struct(l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)"
# The same rows as above in the form that Spark runs: prices at either end of a day by aggregates, which are made before the shuffle, instead of windows, for
# which every line item is shuffled and sorted twice.
SPARK_SQL = {
    "bars": f"""
with t as (select s.s_nationkey as symbol, cast(l.l_shipdate as date) as date, l.l_extendedprice/l.l_quantity as px, l.l_quantity as q, {_FIRST} as k
 from {{lineitem}} l join {{supplier}} s on l.l_suppkey=s.s_suppkey)
select symbol, date, min_by(px, k) as open, max(px) as high, min(px) as low, max_by(px, k) as close, cast(sum(q) as bigint) as volume from t group by symbol, date""",
    "sessions": f"""
with t as (select s.s_nationkey as symbol, cast(l.l_shipdate as date) as date, (l.l_orderkey*7+l.l_linenumber)%5 as slot, l.l_extendedprice/l.l_quantity as px, l.l_quantity as q, {_FIRST} as k
 from {{lineitem}} l join {{supplier}} s on l.l_suppkey=s.s_suppkey)
select symbol, date, case slot when 0 then 555 when 1 then 570 when 2 then 720 when 3 then 855 else 915 end as minute, min_by(px, k) as open, max(px) as high, min(px) as low, max_by(px, k) as close, cast(sum(q) as bigint) as volume from t group by symbol, date, slot""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table, or a given one as it is."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SPARK_SQL.get(name, SQL[name])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(set(re.findall(r"\{(\w+)\}", text)))}
    return spark.sql(text, **used)


def oracle_with(*names: str) -> str:
    """The same tables as a WITH clause of plain table names."""
    return "with " + ", ".join(f"{n} as ({re.sub(r'[{}]', '', SQL[n]).strip()})" for n in names)
