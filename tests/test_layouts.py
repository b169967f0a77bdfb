"""Files in two layouts of each kind in one folder, and payloads of every shape."""

import datetime as dt

from pyspark.sql import functions as F

from marlstone.operators import history, layouts



def day():
    return F.to_date(F.regexp_extract("file", r"(\d{8})", 1), "yyyyMMdd")


def folder(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_price_files_of_both_layouts(spark, tmp_path):
    files = {
        "cm20240705.csv": "SYMBOL , SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,ISIN,\nA,EQ,1,2,0.5,1.5,9,1.2,100,IN1,\nA,BE,7,7,7,7,7,7,7,IN1,\nB,EQ,1,x,1,1,1,,5,IN2,\nC,EQ,3,3,3,3,3,,,\n",
        "cm20240708.csv": '﻿TradDt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,ISIN\r\n2024-07-08,A,EQ,"1,000.5",2000,900,1500,,"1,234",IN1\r\n2024-07-08,A,EQ,1,2,1,2,1,3.9,IN9\r\n',
        "cm20240709.csv": "nothing here\n",
    }
    lines = layouts.read_lines(spark, folder(tmp_path, files))
    got = {(r["symbol"], r["date"].day): tuple(r)[2:] for r in layouts.daily_prices(lines, day()).collect()}
    assert got == {("A", 5): (1.0, 2.0, 0.5, 1.5, 1.2, 100, "IN1"), ("C", 5): (3.0, 3.0, 3.0, 3.0, None, 0, ""), ("A", 8): (1.0, 2.0, 1.0, 2.0, 1.0, 3, "IN9")}
    only = spark.createDataFrame([("C",), ("C",)], "symbol string")
    assert [r["symbol"] for r in layouts.daily_prices(lines, day(), only).collect()] == ["C"]


def test_open_interest_files(spark, tmp_path):
    files = {
        "oi20240105.csv": '"Participant wise Open Interest (no. of contracts)",,,\nClient Type,Future Index Long,Future Index Short\t,x\nClient,1,2,3\nFII ,"12,345",345,7\n',
        "oi20240108.csv": "Client Type,x,Future Index Short,Future Index Long\nFII,1,10,4\n",
        "oi20240109.csv": "title\nClient Type,Future Index Long,Future Index Short\nFII,-,4\n",
        "oi20240110.csv": "title\nClient Type,Future Index Long,Future Index Short\nPro,1,4\n",
    }
    got = {r["date"].day: r["net"] for r in layouts.net_open_interest(layouts.read_lines(spark, folder(tmp_path, files)), day()).collect()}
    assert got == {5: 12000.0, 8: -6.0}


def test_flow_files(spark, tmp_path):
    files = {
        "named.csv": "A title\nDate,DII Net Value,Net (FII)\n01-Jan-2024,\"-1,234.5\",7\n02/01/2024,-,8\nbad,1,2\n",
        "placed.csv": "Trade Date,a,b,c,d,e,f\n2024-01-03,1,2,3.5,5,6,7.5\n04-01-2024,1,2,,5,6\n",
    }
    got = {r["date"].day: (r["fii"], r["dii"]) for r in layouts.flow_rows(layouts.read_lines(spark, folder(tmp_path, files))).collect()}
    assert got == {1: (7.0, -1234.5), 2: (8.0, None), 3: (3.5, 7.5), 4: (None, None)}


def test_filings_of_both_forms(spark):
    payloads = [
        '[{"symbol": " A ", "broadCastDate": "31-Jan-2024 21:25:51", "fromDate": "01-Oct-2023", "toDate": "31-12-2023", "relatingTo": "Q3", "seqNumber": 17}, {"symbol": "", "broadCastDate": "31-Jan-2024"}, {"symbol": "B", "broadCastDate": "soon"}]',
        '{"data": [{"symbol": "C", "broadcast_Date": "01-Feb-2025 09:05", "qe_Date": "2024-12-31", "type_Sub": "Original", "seq_Id": "x"}]}',
        "not json", None, "[]",
    ]
    got = sorted(tuple(r) for r in layouts.filing_events(spark.createDataFrame([(p,) for p in payloads], "text string")).collect())
    assert got == [
        ("A", dt.datetime(2024, 1, 31, 21, 25, 51), dt.date(2023, 10, 1), dt.date(2023, 12, 31), "Q3", "", "", "", "17"),
        ("C", dt.datetime(2025, 2, 1, 9, 5), None, dt.date(2024, 12, 31), "Original", "", "", "", "x"),
    ]


def test_put_call_shapes(spark):
    texts = ["1.25", '[{"name": "a", "PCR_OI": 0}, {"b": 1, "niftyPcr": "0.9"}]', '{"x": 3, "totalPCR": 1.5, "pcr2": 9}', '{"pcr": null}', "[]", '"text"', "broken", None, "[1, 2]"]
    got = {r["date"]: r["pcr"] for r in layouts.put_call_values(spark.createDataFrame(list(enumerate(texts)), "date int, text string")).collect()}
    assert got == {0: 1.25, 1: 0.9, 2: 1.5}


def test_fundamentals_prefer_keys_and_take_the_latest_annual_flow(spark):
    text = '{"keyMetrics": [{"key": "pe", "value": "-"}, {"key": "peTtm", "value": "12.5"}, {"key": "pb", "value": "3"}], "financials": [{"type": "Annual", "endDate": "2022-03-31", "items": {"operatingCashFlow": "100", "capitalExpenditure": "-40"}}, {"type": "ANNUAL", "endDate": "2023-03-31", "items": {"operatingCashFlow": "1,000", "capitalExpenditure": "-400"}}, {"type": "annual", "endDate": "2024-03-31", "items": {"operatingCashFlow": "1"}}, {"type": "Interim", "endDate": "2025-03-31", "items": {"operatingCashFlow": "1", "capitalExpenditure": "1"}}]}'
    d = spark.createDataFrame([("a", text), ("b", "{}"), ("c", None)], "symbol string, text string")
    got = {r["symbol"]: tuple(r)[1:] for r in layouts.fundamentals_row(d, {"pe_ratio": ["pe", "peTtm"], "pb_ratio": ["pb"]}).collect()}
    assert got == {"a": (12.5, 3.0, 600.0), "b": (None, None, None), "c": (None, None, None)}


def test_underlyings_have_futures_and_a_listing(spark):
    rows = [("1", "A-EQ", "A", "NSE", ""), ("2", "A-EQ", "A", "NSE", ""), ("3", "B-EQ", "B", "NSE", ""), ("4", "A24FUT", "A", "NFO", "FUTSTK"), ("5", "C24FUT", "C", "NFO", "FUTSTK"), ("6", "B24CE", "B", "NFO", "OPTSTK"), ("7", "N", "Nifty", "NSE", "AMXIDX"), ("8", "N", "NIFTY", "BSE", "AMXIDX"), ("9", "T", "011NSETEST", "NFO", "FUTSTK")]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row int, token string, symbol string, name string, exchange string, kind string")
    assert [tuple(r) for r in layouts.underlyings(d).collect()] == [("A", "2")]
    assert {r["name"]: r["token"] for r in layouts.cash_tokens(d).collect()} == {"A": "2", "B": "3", "NIFTY": "7"}


def test_first_source_with_rows_counts_as_a_whole(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "date int, close double")
    got = history.with_fallback(make(), make((2, 2.0)), make((1, 9.0), (2, 9.0))).collect()
    assert [tuple(r) for r in got] == [(2, 2.0, 2)]
    assert history.with_fallback(make(), make()).collect() == []


def test_lock_keeps_rows_without_identity(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, ""), ("a", 3, "y"), ("a", 4, None), ("a", 5, "x"), ("b", 1, ""), ("b", 2, "z"), ("b", 3, "")], "k string, t int, isin string")
    got = sorted((r["k"], r["t"]) for r in history.identity_lock(d, "k", "isin", ["t"]).collect())
    assert got == [("a", 1), ("a", 2), ("a", 4), ("a", 5), ("b", 1), ("b", 3)]


def test_actions_count_on_dates_without_a_bar(spark):
    d = lambda k: dt.date(2020, 1, k)
    bars = spark.createDataFrame([("a", d(1), 100.0), ("a", d(3), 50.0), ("a", d(5), 10.0)], "symbol string, date date, close double")
    actions = spark.createDataFrame([("a", d(2), 2.0), ("a", d(5), 5.0), ("a", d(9), 3.0)], "symbol string, date date, ratio double")
    got = {r["date"].day: (r["factor"], r["adjusted"]) for r in history.adjusted_closes(bars, actions).collect()}
    assert {k: round(v[0], 6) for k, v in got.items()} == {1: 30.0, 3: 15.0, 5: 3.0}
