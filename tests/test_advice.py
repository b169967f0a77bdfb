"""Queries that once did less than the whole job, against plain Python."""

import calendar
import datetime as dt
import math

import pandas as pd

from marlstone import catalog
from marlstone.operators import align, labels, studies
from marlstone.sources.adapters import table

SF = "/root/testdata/sf0.001"


def test_uniqueness_weighs_the_label_of_every_bar(spark):
    bars = table(spark, SF, "bars").cache()
    dates = {}
    for r in bars.select("symbol", "date").orderBy("symbol", "date").collect():
        dates.setdefault(r["symbol"], []).append(r["date"])
    spans = {}
    for r in labels.barrier_labels(bars).where("label is not null").collect():
        own = dates[r["symbol"]]
        spans[r["symbol"], r["date"]] = own[own.index(r["date"]) + r["bars_held"]]
    days = sorted({t0 for _, t0 in spans})
    alive = {d: sum(t0 <= d <= t1 for (_, t0), t1 in spans.items()) for d in days}
    want = {}
    for (symbol, t0), t1 in spans.items():
        share = [1 / alive[d] for d in days if t0 <= d <= t1]
        want[symbol, t0] = (t1, sum(share) / len(share))
    got = {(r["symbol"], r["t0"]): (r["t1"], r["weight"]) for r in catalog.queries()["uniqueness_weights"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 1000
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def months_traded(spark):
    """(index_name, symbol) to its months as year * 12 + month - 1, over all orders."""
    nation = {r["c_custkey"]: r["c_nationkey"] for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    out = {}
    for r in spark.read.parquet(f"{SF}/orders.parquet").collect():
        if r["o_custkey"] in nation:
            out.setdefault((r["o_orderpriority"], nation[r["o_custkey"]]), set()).add(r["o_orderdate"].year * 12 + r["o_orderdate"].month - 1)
    return out


def test_spells_are_the_runs_of_months_of_all_orders(spark):
    months = months_traded(spark)
    last = max(max(m) for m in months.values())
    want = set()
    for (index_name, symbol), held in months.items():
        for k in held:
            if k - 1 not in held:
                end = next(e for e in range(k, last + 1) if e + 1 not in held)
                to = None if end == last else dt.date(end // 12, end % 12 + 1, calendar.monthrange(end // 12, end % 12 + 1)[1])
                want.add((index_name, symbol, dt.date(k // 12, k % 12 + 1, 1), to))
    got = [tuple(r) for r in table(spark, SF, "spells").select("index_name", "symbol", "effective_from", "effective_to").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_membership_queries_read_all_orders(spark):
    months = months_traded(spark)
    month = 1998 * 12 + 2
    on = {(r["index_name"], r["symbol"]) for r in catalog.queries()["members_on"](spark, SF).collect()}
    assert on == {k for k, m in months.items() if month in m}
    kept = {(r["symbol"], r["date"]) for r in catalog.queries()["pit_filter_spells"](spark, SF).collect()}
    urgent = {s: m for (i, s), m in months.items() if i == "1-URGENT"}
    last = max(max(m) for m in months.values())
    member = lambda s, k: k in urgent.get(s, ()) or k > last and last in urgent.get(s, ())
    assert kept == {(r["symbol"], r["date"]) for r in table(spark, SF, "bars").collect() if member(r["symbol"], r["date"].year * 12 + r["date"].month - 1)}


def test_news_reads_texts_to_their_ends(spark):
    long = "x" * 90
    rows = [(1, f"{long} the", "a"), (2, f"{long} of\nthe the", "b"), (3, f"{long} the", "c"), (4, long, "d")]
    news = spark.createDataFrame([(0, dt.date(2024, 1, 1), s, t, i) for i, t, s in rows], "symbol long, date date, source string, headline string, doc_id long")
    r = studies.news_sentiment(news).first()
    assert r["n_articles"] == 2 and abs(r["sent_score"] - (1 + 1 / 3) / 2) < 1e-12 and r["sources"] == "a,b"
    whole = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        whole.setdefault((r["doc_id"] % 25, r["text"]), r["doc_id"] % 30)
    scored = {}
    for (symbol, text), day in whole.items():
        hits = [studies.LEXICON[w] for w in (text or "").lower().split() if w in studies.LEXICON]
        scored.setdefault((symbol, dt.date(2024, 1, 1) + dt.timedelta(day)), []).extend([sum(hits) / len(hits)] if hits else [])
    got = {(r["symbol"], r["date"]): (r["n_articles"], r["sent_score"]) for r in catalog.queries()["news_sentiment"](spark, SF).collect()}
    assert got.keys() == scored.keys()
    assert all(got[k][0] == len(v) and (not v or abs(got[k][1] - sum(v) / len(v)) < 2e-6) for k, v in scored.items())


def reference_labels(close, days=20, width=2.5, cost=0.0015):
    """Labels of a list of closes by loops: one net return for both barriers, null without a deviation or a whole path."""
    sigma = pd.Series(close).pct_change().ewm(span=20, min_periods=10).std()
    out = []
    for i, p in enumerate(close):
        w = max(width * sigma[i], cost) if sigma[i] == sigma[i] else math.nan
        if w != w or w <= 0 or i + days >= len(close):
            out.append((None, None))
            continue
        hit = next(((k, 1 if x >= w else -1) for k in range(1, days + 1) if (x := close[i + k] / p - 1 - cost) >= w or x <= -w), (days, 0))
        out.append((hit[1], hit[0]))
    return out


def test_barrier_labels_follow_net_returns_and_weighted_deviations(spark):
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(k), 100 + 9 * math.sin(k * f) + (k * 7 % 5) / 3) for s, f in (("a", 0.2), ("b", 0.05)) for k in range(150)]
    d = spark.createDataFrame(rows, "symbol string, date date, close double")
    for s in ("a", "b"):
        want = reference_labels([r[2] for r in rows if r[0] == s])
        got = [(r["label"], r["bars_held"]) for r in labels.barrier_labels(d).where(f"symbol = '{s}'").orderBy("date").collect()]
        assert got == want and {-1, 1, None} <= {x for x, _ in got}
    flat = [(s, day, 50.0) for s, day, _ in rows if s == "a"]
    assert {r["label"] for r in labels.barrier_labels(spark.createDataFrame(flat, "symbol string, date date, close double")).collect()} <= {0, -1, None}


def test_interval_errors_go_by_index_and_symbol(spark):
    d = lambda k: dt.date(2020, 1, k)
    rows = [
        ("i", "a", d(1), d(5)), ("j", "a", d(2), d(9)),  # two indices: no error
        ("i", "b", d(9), d(3)), ("i", "b", d(10), None),  # inverted, and not the one before the next
        ("i", "c", d(1), d(4)), ("i", "c", d(1), None), ("i", "c", d(6), d(7)),  # a repeated key whose open row overlaps
    ]
    m = spark.createDataFrame(rows, "index_name string, symbol string, effective_from date, effective_to date")
    got = sorted((r["symbol"], r["effective_from"].day, r["error"]) for r in align.interval_errors(m).collect())
    assert got == [("b", 9, "inverted"), ("c", 1, "duplicate"), ("c", 6, "overlap")]


def test_asof_without_a_key_sorts_times_and_not_rows(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(4)]
    left = spark.createDataFrame([(s, d) for s in range(500) for d in days], "symbol int, date date").unionByName(spark.createDataFrame([(7, None)], "symbol int, date date"))
    right = spark.createDataFrame([(days[1], 10.0), (days[3], None)], "date date, v double")
    out = align.asof(left, right, "v", [])
    got = out.groupBy("date", "v").count().collect()
    assert {(r["date"], r["v"], r["count"]) for r in got} == {(days[0], None, 500), (days[1], 10.0, 500), (days[2], 10.0, 500), (days[3], 10.0, 500), (None, None, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(k for k, line in enumerate(plan) if "Window" in line)
    assert any("Aggregate" in line for line in plan[at:])  # the times are made distinct below the window
