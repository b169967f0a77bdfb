"""Studies, rebuilt memberships and file lines against hand-made cases."""

from datetime import date, timedelta
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from marlstone.functions.expr import norm_ppf
from marlstone.operators import research


def test_normal_quantile(spark):
    ps = [1e-9, 0.001, 0.02, 0.03, 0.3, 0.5, 0.7, 0.96, 0.98, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(norm_ppf(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-8, abs=1e-8)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(norm_ppf(F.col("p"))).collect()] == [None] * 3


def test_deflated_sharpe_lies_below_the_plain_one(spark):
    rows = [(s, float(((k * 37 + s * 11) % 19 - 9) / 100 + s / 1000)) for s in range(6) for k in range(60)]
    d = {r.s: r for r in research.deflated_sharpe(spark.createDataFrame(rows, "s int, r double"), "s", "r").collect()}
    n = NormalDist()
    srs = [d[s].sr for s in range(6)]
    mean = sum(srs) / 6
    spread = (sum((x - mean) ** 2 for x in srs) / 5) ** 0.5
    floor = spread * ((1 - 0.5772156649015329) * n.inv_cdf(1 - 1 / 6) + 0.5772156649015329 * n.inv_cdf(1 - 1 / (6 * 2.718281828459045)))
    assert all(r.expected_max == pytest.approx(floor, rel=1e-6) for r in d.values())
    one = research.deflated_sharpe(spark.createDataFrame(rows[:60], "s int, r double"), "s", "r").collect()
    assert one[0].expected_max == 0 and one[0].dsr > d[0].dsr
    assert research.deflated_sharpe(spark.createDataFrame([], "s int, r double"), "s", "r").count() == 0


def test_spells_go_back_from_the_present(spark):
    d = date
    now = spark.createDataFrame([("X", "A"), ("X", "B"), ("X", "E")], "index_name string, symbol string")
    changes = spark.createDataFrame(
        [
            ("X", "B", d(2020, 3, 1), True, False),  # came in: no member before
            ("X", "C", d(2020, 5, 1), False, True),  # went out: a member from the start
            ("X", "D", d(2020, 2, 1), True, False), ("X", "D", d(2020, 6, 1), False, True),
            ("X", "E", d(2020, 4, 1), True, False), ("X", "E", d(2020, 4, 1), False, True),  # out and in on one date: no break
            ("X", "F", d(2020, 4, 1), True, False),  # came in, yet no member today
        ],
        "index_name string, symbol string, date date, included boolean, excluded boolean",
    )
    got = sorted((r.symbol, r.effective_from, r.effective_to) for r in research.rebuild_spells(now, changes, "2020-01-01").collect())
    s = d(2020, 1, 1)
    assert got == [("A", s, None), ("B", d(2020, 3, 1), None), ("C", s, d(2020, 4, 30)), ("D", d(2020, 2, 1), d(2020, 5, 31)), ("E", s, None)]
    assert research.rebuild_spells(now, changes.limit(0), "2020-01-01").count() == 3
    assert research.rebuild_spells(now.limit(0), changes.limit(0), "2020-01-01").count() == 0


def test_member_lines_stop_at_a_bad_one(spark):
    lines = [(1, "A, ,2020-01-02,"), (2, 'B,"X Y",2020/01/03,05-Feb-2020'), (3, " C ,Z,04-01-2020, ")]
    df = spark.createDataFrame(lines, "line int, text string")
    got = sorted(tuple(r) for r in research.parse_members(df, "D").collect())
    assert got == [("A", "D", date(2020, 1, 2), None), ("B", "X Y", date(2020, 1, 3), date(2020, 2, 5)), ("C", "Z", date(2020, 1, 4), None)]
    for text in (",X,2020-01-02,", "A,X,yesterday,", "A,X,2020-01-02,soon"):
        with pytest.raises(Exception, match="membership line 7 "):
            research.parse_members(spark.createDataFrame([(7, text)], "line int, text string"), "D").collect()


def test_levels_deals_and_pages(spark):
    levels = [(1, " 2020-01-02 , 11.5 "), (2, "02-Jan-2020,12"), (3, "2020-01-03,0"), (4, "date,close"), (5, "2020-01-04"), (6, None), (7, "Jan 5, 2020")]
    assert [tuple(r) for r in research.parse_index_levels(spark.createDataFrame(levels, "line int, text string")).collect()] == [(date(2020, 1, 2), 12.0)]
    deals = [("﻿01-Jan-2020,AB,Some One,buy,\"1,234\",\"1,000.50\"",), ("Date,Symbol,Client,Side,Quantity,Price",), ("02/01/2020,AB,X,SELL,5,-",)]
    got = [tuple(r) for r in research.parse_deals(spark.createDataFrame(deals, "text string")).orderBy("date").collect()]
    assert got == [(date(2020, 1, 1), "AB", "Some One", "BUY", 1234.0, 1000.5), (date(2020, 1, 2), "AB", "X", "SELL", 5.0, None)]
    page = '<p>x</p>\n<script id="__NEXT_DATA__" a="b">{"props":{"pageProps":{"FiiDiiData":{"fiiDiiData":[{"date":"01-Jan-2020","fiiNet":"-1,200.5","diiNet":"-"},{"date":"?"}]}}}}</script><script>{}</script>'
    assert [tuple(r) for r in research.parse_flow_pages(spark.createDataFrame([(page,)], "html string")).collect()] == [(date(2020, 1, 1), -1200.5, None)]
    for bad in ("<p/>", page.replace("01-Jan-2020", "?"), page.replace("FiiDiiData", "Other"), None):
        with pytest.raises(Exception, match="no rows that can be read"):
            research.parse_flow_pages(spark.createDataFrame([(bad,)], "html string")).collect()


def test_entries_wait_for_a_high_percentile(spark):
    n = 60
    composite = [50.0 if k in (5, 6, 20, 50) else 10.0 for k in range(n)]  # crossings at 5, 20 and 50; the last has no exit
    pct = [0.1] * n
    pct[7] = 0.5  # the second bar after the crossing at 5
    rows = [("S", date(2020, 1, 1) + timedelta(k), float(100 + k), composite[k], pct[k]) for k in range(n)]
    ev = research.entry_timing(spark.createDataFrame(rows, "symbol string, date date, close double, composite double, pct double"))
    got = {(r.cohort, (r.date - date(2020, 1, 1)).days): r for r in ev.collect()}
    assert sorted(got) == [("signal", 5), ("signal", 20), ("steady", 30), ("steady", 35)]
    assert got["signal", 5].waited == 1 and got["signal", 20].waited == 2
    assert got["signal", 5].ret_base == pytest.approx(126 / 106 - 1) and got["signal", 5].ret_timed == pytest.approx(126 / 107 - 1)
    s = {r.cohort: r for r in research.timing_summary(ev).collect()}
    assert s["signal"].n == 2 and s["signal"].mean_diff is None  # too few
    assert research.timing_summary(ev, 2).where("cohort = 'signal'").first().waited_mean == 1.5


def test_monthly_momentum_by_hand(spark):
    days = [date(2020, 1, 1) + timedelta(k) for k in range(400)]
    grow = {"A": 1.001, "B": 1.002, "C": 0.999, "D": 1.0}
    rows = [(s, d, 100 * g**k) for s, g in grow.items() for k, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    bench = spark.createDataFrame([(d, 50.0) for d in days], "date date, close double")
    m = research.monthly_momentum(bars, bench, top=1, leg=1, least=4).orderBy("date").collect()
    assert [r.date for r in m] == [date(2020, 9, 30), date(2020, 10, 31), date(2020, 11, 30), date(2020, 12, 31), date(2021, 1, 31)]  # the last one settles on the last date there is
    first, second = m[0], m[1]
    assert first.lo_gross == pytest.approx(1.002**31 - 1) and first.ls_gross == pytest.approx(1.002**31 - 0.999**31)
    assert (first.lo_turnover, first.ls_turnover, second.lo_turnover, second.ls_turnover) == (1, 1, 0, 0)
    assert first.lo_net == pytest.approx(first.lo_gross - 0.006) and first.excess == pytest.approx(first.lo_net)
    assert research.monthly_momentum(bars, bench).count() == 0  # too few names
    g = research.momentum_gates(research.monthly_momentum(bars, bench, top=1, leg=1, least=4)).first()
    assert g.months == 5 and g.passed is False


@pytest.mark.parametrize(
    "ics, want",
    [
        ((0.3, 0.1, 0.05, 0.05), (0.4, 0.3, 0.15, 0.15)),  # the first is held, the rest share 0.6
        ((0.1, 0.1, 0.05, 0.01), (0.4, 0.4, 0.2, 0.0)),  # below the floor: nothing
        ((0.5, 0.5, 0.03, 0.0), (0.4, 0.4, 0.2, 0.0)),
        ((0.5, 0.1, 0.02, 0.0), (0.4, 0.4, 0.2, 0.0)),  # the second goes over the cap only after the first is held
        ((0.1, 0.0, -0.3, 0.0), (0.4, 0.2, 0.2, 0.2)),  # what is left goes to the others by their static weights
        ((0.0, 0.01, -0.3, None), (0.4, 0.2, 0.2, 0.2)),  # nothing counts: static
    ],
)
def test_ic_weights_hold_the_cap(spark, ics, want):
    static = dict(zip("abcd", (0.4, 0.2, 0.2, 0.2)))
    df = spark.createDataFrame([(f, x, 30) for f, x in zip("abcd", ics)], "factor string, mean_ic double, dates long")
    got = {r.factor: r.weight for r in research.ic_weights(df, static).collect()}
    assert [got[f] for f in "abcd"] == pytest.approx(want, abs=1e-4)
