"""Ledger, values by date, limits, stops, retirement and earnings drift on small tables made by hand."""

import datetime as dt
import random

import pytest

from marlstone.operators import earnings, fund

LEDGER = "sleeve string, instrument int, trade_date date, id long, line int, supp long, side string, qty double, price double, fees double"


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def ledger(spark, rows):
    return spark.createDataFrame([(s, i, day(d), n, 1, 1, side, float(q), float(p), float(f) if f is not None else None) for n, (s, i, d, side, q, p, f) in enumerate(rows)], LEDGER)


def replayed(rows):
    """Row by row: the rule as it is told."""
    held, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        qty, cost = held.get(r[:2], (0.0, 0.0))
        if r[6] == "BUY":
            qty, cost = qty + r[7], cost + r[7] * r[8] + (r[9] or 0.0)
        else:
            qty, cost = qty - r[7], cost - r[7] * (cost / qty if qty > 0 else 0.0)
        held[r[:2]] = out[(*r[:2], r[2])] = (qty, cost)
    return held, out


def test_sold_share_leaves_the_cost_and_short_positions_keep_it(spark):
    got = {(r["sleeve"], r["instrument"]): (r["qty"], r["invested"], r["avg_cost"], r["trades"]) for r in fund.positions(ledger(spark, [
        ("core", 1, 0, "BUY", 100, 280, 20), ("core", 1, 1, "SELL", 50, 300, 5),
        ("a", 2, 0, "SELL", 10, 7, 0), ("a", 2, 1, "BUY", 20, 5, 0),  # ten short, then twenty at five: all that was paid stands for the ten left
        ("a", 3, 0, "BUY", 10, 5, 0), ("a", 3, 1, "SELL", 10, 9, 0),  # closed
        ("a", 4, 0, "SELL", 5, 1, None), ("cash", 0, 0, "DEPOSIT", 500, 1, 0),
    ])).collect()}
    assert got == {("core", 1): (50.0, 14010.0, 280.2, 2), ("a", 2): (10.0, 100.0, 10.0, 2)}


def test_cash_counts_deposits_withdrawals_and_fees(spark):
    d = ledger(spark, [("c", 0, 0, "DEPOSIT", 500000, 1, 0), ("c", 1, 1, "BUY", 100, 280, 20), ("c", 1, 2, "SELL", 10, 300, 5), ("c", 0, 3, "WITHDRAW", 1000, 1, 2), ("e", 0, 3, "DEPOSIT", 7, 1, None)])
    assert {r["sleeve"]: r["cash"] for r in fund.cash(d).collect()} == {"c": 500000 - 28020 + 2995 - 1002, "e": 7.0}


@pytest.mark.parametrize("run_rows", [150, 100_000])
def test_states_of_a_hot_key_match_a_replay(spark, run_rows):
    rng = random.Random(3)
    rows = [("s" if k % 3 else f"s{k % 4}", 1, day(rng.randrange(40)), k, 1, 1, rng.choice(["BUY", "BUY", "SELL"]), float(rng.randrange(1, 9)), 50 + 50 * rng.random(), rng.random()) for k in range(2000)]
    d = spark.createDataFrame(rows, LEDGER)
    if run_rows < 1000:
        assert max(r["count"] for r in fund.ledger_runs(d, run_rows).groupBy("sleeve", "run").count().collect()) < 600  # of 1,333 of the hot key
    _, want = replayed(rows)
    got = {(r["sleeve"], r["instrument"], r["trade_date"]): (r["qty"], r["invested"]) for r in fund.daily_states(d, run_rows).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-6) for k in want)


def test_values_by_date(spark):
    d = ledger(spark, [("a", 0, 0, "DEPOSIT", 1000, 1, 0), ("a", 1, 1, "BUY", 10, 20, 0), ("b", 2, 3, "BUY", 1, 5, 0), ("a", 1, 5, "SELL", 10, 30, 0)])
    prices = spark.createDataFrame([(1, day(2), 25.0), (1, day(4), 10.0)], "instrument int, date date, close double")
    got = {(r["sleeve"], r["date"]): (r["market_value"], r["cash"], r["nav"]) for r in fund.nav_history(d, prices).collect()}
    assert got == {
        ("a", day(0)): (0.0, 1000.0, 1000.0), ("a", day(1)): (200.0, 800.0, 1000.0),  # no close yet: at cost
        ("a", day(3)): (250.0, 800.0, 1050.0), ("a", day(5)): (0.0, 1100.0, 1100.0),
        ("b", day(3)): (5.0, -5.0, 0.0), ("b", day(5)): (5.0, -5.0, 0.0),
    }


def test_flags(spark):
    held = spark.createDataFrame([("core", 1, 10.0, 400.0), ("x", 2, 10.0, 300.0), ("x", 3, 10.0, 200.0), ("x", 4, 1.0, 10.0)], "sleeve string, instrument int, qty double, invested double")
    prices = spark.createDataFrame([(1, day(0), 40.0), (2, day(0), 30.0), (3, day(0), 99.0), (3, day(1), 15.5)], "instrument int, date date, close double")
    cash = spark.createDataFrame([("c", 135.0)], "sleeve string, cash double")  # 400 + 300 + 155 + 10 + 135
    budgets = spark.createDataFrame([("core", 36.0), ("x", 41.0), ("y", 1.0)], "sleeve string, budget_pct double")
    got = {(r["kind"], r["sleeve"], r["instrument"]): (r["severity"], r["pct"]) for r in fund.fund_flags(held, cash, prices, budgets, "core").collect()}
    assert got == {("position_hard_cap", "x", 2): ("critical", 30.0), ("position_cap", "x", 3): ("warning", 15.5), ("position_drawdown", "x", 3): ("warning", -22.5), ("sleeve_budget", "x", None): ("warning", 46.5)}


def test_stops_by_hand(spark):
    close = [100.0] * 25 + [110.0, 120.0, 119.0, 80.0, 130.0]
    bars = spark.createDataFrame([("a", day(k), c + 1, c - 1, c) for k, c in enumerate(close)], "symbol string, date date, high double, low double, close double")
    entry = spark.createDataFrame([("a", day(20), 100.0)], "symbol string, entry_date date, entry_price double")
    rows = fund.hybrid_stops(bars, entry).orderBy("date").collect()
    assert rows[0]["vol_stop"] == 100.0 and rows[0]["trail_stop"] is None and rows[0]["triggered"]  # no deviation yet: the stop is the entry itself
    k = 24 - 20
    assert rows[k]["trail_stop"] == pytest.approx(101 - 3 * 2) and rows[k]["method"] == "hybrid:volatility"
    atr = 2.0
    for k, tr in ((25, 11.0), (26, 11.0), (27, 2.0), (28, 40.0), (29, 51.0)):
        atr = (atr * 13 + tr) / 14
        top = max(c + 1 for c in close[: k + 1][-22:])
        assert rows[k - 20]["trail_stop"] == pytest.approx(top - 3 * atr)
    assert [r["ratchet"] for r in rows] == [max(x["stop"] for x in rows[: i + 1]) for i in range(len(rows))]
    assert rows[-1]["close"] > rows[-1]["stop"] and rows[-1]["stopped"]


def test_retirement_counts_sessions_and_not_days(spark):
    rows = [("every", day(7 * k)) for k in range(20)] + [("gone", day(7 * k)) for k in (0, 1, 2, 8, 9)] + [("back", day(7 * k)) for k in (0, 1, 2, 7, 8)]
    d = fund.retire(spark.createDataFrame(rows, "symbol string, date date"), absent=5)
    assert {s: d.where(f"symbol = '{s}'").count() for s in ("every", "gone", "back")} == {"every": 20, "gone": 3, "back": 5}
    assert fund.retire(spark.createDataFrame(rows, "symbol string, date date"), absent=4).where("symbol = 'back'").count() == 3


def test_reaction_bar_on_both_sides_of_the_close(spark):
    at = lambda d, h, m, s=0: dt.datetime(2020, 1, 1, h, m, s) + dt.timedelta(days=d)
    bars = spark.createDataFrame([("a", day(k)) for k in (0, 1, 2, 5, 12)], "symbol string, date date")
    events = spark.createDataFrame([("a", 1, at(1, 15, 30)), ("a", 2, at(1, 15, 30, 1)), ("a", 3, at(3, 9, 0)), ("a", 4, at(2, 16, 0)), ("a", 5, at(6, 9, 0)), ("a", 6, at(7, 9, 0)), ("a", 7, at(13, 9, 0)), ("b", 8, at(1, 9, 0))], "symbol string, period int, ts timestamp_ntz")
    from pyspark.sql import functions as F

    got = {r["period"]: r["date"] for r in earnings.reaction_bars(events, bars, F.lit(1)).collect()}
    assert got == {1: day(1), 2: day(2), 3: day(5), 4: day(5), 6: day(12)}  # 5 days later still counts, 6 (event 5) doesn't


def test_first_broadcast_and_terciles(spark):
    at = lambda d, h: dt.datetime(2020, 1, 1, h) + dt.timedelta(days=d)
    rng = random.Random(1)
    bars = spark.createDataFrame([(f"s{n}", day(k), 100.0 + rng.random()) for n in range(7) for k in range(120)], "symbol string, date date, close double")
    bench = spark.createDataFrame([(day(k), 50.0) for k in range(120)], "date date, close double")
    filings = [(f"s{n}", 1, at(10 + n, 10)) for n in range(7)] + [("s0", 1, at(30, 10)), ("s1", 2, at(119, 10)), ("s2", None, at(5, 1)), ("s3", 3, None)]
    d = earnings.earnings_drift(spark.createDataFrame(filings, "symbol string, period int, ts timestamp_ntz"), bars, bench).orderBy("reaction").collect()
    assert len(d) == 7 and {r["symbol"]: r["date"] for r in d}["s0"] == day(10)
    assert [r["tercile"] for r in d] == ["T1_neg"] * 3 + ["T2_mid"] * 2 + ["T3_pos"] * 2
    closes = {(r["symbol"], r["date"]): r["close"] for r in bars.collect()}
    r = d[0]
    assert r["ar20"] == pytest.approx(closes[r["symbol"], r["date"] + dt.timedelta(days=20)] / closes[r["symbol"], r["date"]] - 1)
    table = earnings.drift_table(spark.createDataFrame(d)).collect()
    assert len(table) == 9 and all(r["insufficient"] and r["mean_bp"] is None for r in table)
