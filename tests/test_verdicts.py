"""Verdicts, log, queue, strategies, replies, sentiment, condors and tranches on small tables made by hand."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from marlstone.operators import fund, options, sentiment, signals, verdicts


def day(k, start=dt.date(2020, 1, 1)):
    return start + dt.timedelta(days=k)


def judged(spark, *rows):
    """Rows by (symbol, sub-scores, other columns); what isn't given is unknown."""
    base = {"date": day(0), "close": 100.0, "data_points": 60, "sma20": 98.0, "sma50": 90.0, "upper": 110.0, "lower": 90.0}
    scores = ", ".join(f"{k} double" for k in verdicts.WEIGHTS)
    shape = f"symbol string, date date, close double, data_points int, sma20 double, sma50 double, upper double, lower double, {scores}, ml_verdict string, ml_confidence double"
    names = [c.strip().split()[0] for c in shape.split(",")]
    made = [{**base, "symbol": s, **scores, **other} for s, scores, other in rows]
    return {r["symbol"]: r for r in verdicts.verdicts(spark.createDataFrame([tuple(m.get(c) for c in names) for m in made], shape)).collect()}


def test_verdicts_votes_targets_and_reasons(spark):
    strong = {k: 1.0 for k in verdicts.WEIGHTS}
    got = judged(
        spark, ("up", strong, {}), ("down", {k: -1.0 for k in strong}, {}), ("none", {}, {}), ("few", strong, {"data_points": 29}),
        ("model", {"rsi": 1.0, "macd": -0.5}, {"ml_verdict": "SELL", "ml_confidence": 77.0}), ("bare", strong, {"sma20": None, "lower": None}),
        ("cheap", strong, {"lower": 50.0}), ("edge", {"composite_factor": 1.0, "rsi": 1.0, "macd": 1.0, "vix_regime": 0.75}, {}),
    )
    assert (got["up"]["verdict"], got["up"]["score"], got["up"]["confidence"]) == ("BUY", 1.0, 100.0)  # the weights sum to one; flows vote too
    assert sum(verdicts.WEIGHTS.values()) == pytest.approx(1.0)
    assert (got["up"]["target"], got["up"]["target_type"]) == (95.0, "entry")  # half-way is 94, below the floor of 95
    assert (got["down"]["verdict"], got["down"]["target"], got["down"]["target_type"]) == ("SELL", 104.0, "exit")
    assert (got["none"]["verdict"], got["none"]["score"], got["none"]["confidence"], got["none"]["target_type"]) == ("HOLD", 0.0, 100.0, "fair_value")
    assert got["none"]["reasoning"].startswith("Signals are mixed") and got["down"]["reasoning"].startswith("Bearish: Composite Factor, Rsi")
    assert (got["few"]["verdict"], got["few"]["score"], got["few"]["target"]) == ("INSUFFICIENT_DATA", 0.0, None)
    assert (got["model"]["verdict"], got["model"]["confidence"], got["model"]["method"]) == ("SELL", 77.0, "model")
    assert got["model"]["reasoning"] == "Bullish: Rsi | Bearish: Macd" and got["model"]["score"] == pytest.approx(0.045)
    assert got["bare"]["target"] == 99.0 and got["cheap"]["target"] == 95.0
    assert (got["edge"]["score"], got["edge"]["verdict"]) == (0.35, "BUY")
    assert got["edge"]["confidence"] == round(4 / 18 * 100, 1)


def test_fundamentals_and_ratings(spark):
    rows = spark.createDataFrame([("a", 5.0, -1.0, None, 2.0, 10.0), ("b", None, None, None, None, None), ("c", 35.0, 3.0, 0.0, None, -10.0)], "symbol string, pe_ratio double, pb_ratio double, free_cash_flow double, current_ratio double, revenue_growth_5y double")
    got = {r["symbol"]: tuple(round(r[c], 6) for c in ("valuation", "financial_health", "growth")) for r in verdicts.fundamental_scores(rows).collect()}
    assert got == {"a": (1.0, 0.5, round(10 / 15, 6)), "b": (0.0, 0.0, 0.0), "c": (-0.5, -0.5, round(-10 / 15, 6))}
    ratings = spark.createDataFrame([("a", 2, 1, 1, None, 0), ("b", 0, 0, 0, 0, None), ("c", 0, 0, 0, 3, 1)], "symbol string, strong_buy int, buy int, hold int, sell int, strong_sell int")
    assert {r["symbol"]: r[1] for r in verdicts.analyst_consensus(ratings).collect()} == {"a": 0.75, "c": -1.0}


def test_peers_are_the_first_others_of_the_sector(spark):
    closes = {0: 1.0, 1: 1.1, 2: 1.2, 3: None, 4: 1.4}  # growth over the last three bars; 3 has two bars only
    bars = spark.createDataFrame([(s, day(k), 100.0 * (g or 9) ** (k / 2)) for s, g in closes.items() for k in range(3 if g else 2)], "symbol int, date date, close double")
    bench = spark.createDataFrame([(day(k), 100.0 + k) for k in range(3)], "date date, close double")
    sectors = spark.createDataFrame([(s, "x") for s in closes] + [(9, "y")], "symbol int, sector string")
    for most in (2, 3, 20):
        got = {r["symbol"]: r[1] for r in verdicts.peer_rotation(bars, bench, sectors, n=3, most=most).collect()}
        for s in closes:
            peers = [closes[p] - 1 for p in [p for p in sorted(closes) if p != s][:most] if closes[p]]
            assert got[s] == pytest.approx(max(-1, min(1, (statistics.mean(peers) - 0.02) / 0.2)))
        assert got[9] == 0.0
    assert verdicts.peer_rotation(bars, bench.limit(0), sectors, n=3).where("symbol = 4").first()[1] == pytest.approx(statistics.mean([0.0, 0.1, 0.2]) / 0.2)
    assert verdicts.peer_rotation(bars.limit(0), bench, sectors, n=3).agg(F.max(F.abs("sector_rotation"))).first()[0] == 0.0


def test_backfill_and_log(spark):
    linear = spark.createDataFrame([("a", day(0), 50.0, "LONG"), ("a", day(1), 0.0, "HOLD"), ("b", day(0), -60.0, "SHORT")], "symbol string, date date, composite double, linear_signal string")
    model = spark.createDataFrame([("a", day(0), "SHORT", 80.0), ("a", day(1), None, 90.0), ("z", day(0), "LONG", 60.0)], "symbol string, date date, ml_verdict string, ml_confidence double")
    rows = verdicts.backfilled(linear, model)
    assert {(r["symbol"], r["date"], r["signal"], r["ml_confidence"]) for r in rows.collect()} == {("a", day(0), "SHORT", 80.0), ("a", day(1), "HOLD", None), ("b", day(0), "SHORT", None)}
    log = spark.createDataFrame([("a", day(1), "LONG", 1.0, 70.0, "LONG", "seen"), ("c", day(0), "HOLD", 1.0, None, None, "x"), ("d", day(0), "HOLD", 1.0, None, "HOLD", "y")], "symbol string, date date, signal string, composite double, ml_confidence double, linear_signal string, note string")
    got = {(r["symbol"], r["date"]): (r["signal"], r["composite"], r["ml_confidence"], r["note"]) for r in verdicts.merged_log(log, rows).collect()}
    assert got == {("a", day(0)): ("SHORT", 50.0, 80.0, None), ("a", day(1)): ("HOLD", 0.0, None, "seen"), ("b", day(0)): ("SHORT", -60.0, None, None), ("d", day(0)): ("HOLD", 1.0, None, "y")}
    assert verdicts.merged_log(log.limit(0), rows).count() == 3 and verdicts.merged_log(log, rows.limit(0)).count() == 2


def test_queue_skips_and_gaps(spark):
    friday = dt.date(2024, 3, 1)
    shape = "symbol string, date date, close double, composite double, linear_signal string, ml_path boolean, ml_confidence double, meta_prob double, avg_volume double, data_points int"
    rows = signals.conviction(spark.createDataFrame([
        ("ok", friday, 100.0, 50.0, "LONG", True, 60.0, 0.8, 1e6, 300), ("thin", friday, 10.0, 50.0, "LONG", False, None, 0.8, 10.0, 300), ("gap", friday, 100.0, 50.0, "LONG", False, None, 0.8, 1e6, 300),
        ("new", friday, 100.0, 50.0, "LONG", False, None, 0.8, 1e6, 300), ("edge", friday, 100.0, 50.0, "LONG", False, None, 0.8, 1e6, 300), ("weak", friday, 9.0, 1.0, None, False, None, None, 1e6, 300),
    ], shape))
    queue = verdicts.signal_queue(rows)
    assert {(r["symbol"], r["execute_on"], r["source"]) for r in queue.collect()} == {(s, dt.date(2024, 3, 4), "MODEL" if s == "ok" else "LINEAR") for s in ("ok", "gap", "new", "edge")}
    assert {(r["symbol"], r["gate"]) for r in verdicts.skipped(rows).collect()} == {("thin", "liquidity_adv"), ("weak", "composite"), ("weak", "linear_agreement"), ("weak", "meta_labeler")}
    later = dt.date(2024, 3, 5)
    bars = spark.createDataFrame([("ok", friday, 102.0), ("ok", later, 900.0), ("gap", friday, 96.5), ("edge", friday, 103.0), ("new", later, 100.0)], "symbol string, date date, close double")
    done = queue.where("symbol = 'ok'").withColumn("status", F.lit("executed")).withColumn("symbol", F.lit("gap"))
    got = {(r["symbol"], r["status"]): (r["price"], r["gap_pct"], r["reason"]) for r in verdicts.gap_checked(queue.unionByName(done), bars).collect()}
    assert got == {("ok", "pending"): (102.0, 2.0, None), ("gap", "rejected_gap"): (96.5, 3.5, "gap 3.50% exceeds 3% limit"), ("edge", "pending"): (103.0, 3.0, None), ("new", "rejected_risk"): (None, None, "no_current_price"), ("gap", "executed"): (None, None, None)}


def test_regime_switches_the_strategy(spark):
    closes = [100.0] * 12 + [80.0, 82.0, 120.0, 90.0]
    bars = spark.createDataFrame([("a", day(k), c) for k, c in enumerate(closes)], "symbol string, date date, close double")
    held, out = 0, []
    for k in range(len(closes)):
        past = closes[max(0, k - 19) : k + 1]
        sd = statistics.stdev(past) if len(past) >= 10 else 0
        z = (closes[k] - statistics.mean(past)) / sd if sd else 0.0
        held = 1 if not held and z < -1.5 else 0 if held and z >= 0 else held
        out.append(held)
    assert [r["signal"] for r in verdicts.reversion_signals(bars).orderBy("date").collect()] == out and 1 in out
    linear = bars.withColumn("signal", F.lit(-1))
    blend = spark.createDataFrame([(day(12), -0.5), (day(13), 0.5), (day(14), 0.15)], "date date, regime double")
    got = {r["date"]: r["signal"] for r in verdicts.adaptive_signals(linear, bars, blend).collect()}
    assert (got[day(12)], got[day(13)], got[day(14)], got[day(15)]) == (1, -1, 0, 0)
    model = spark.createDataFrame([("a", day(1), "LONG"), ("b", day(0), "LONG")], "symbol string, date date, ml_verdict string")
    both = linear.unionByName(linear.withColumn("symbol", F.lit("c")))
    got = {(r["symbol"], r["date"]): r["signal"] for r in verdicts.model_signals(both, model).collect()}
    assert (got["a", day(0)], got["a", day(1)], got["c", day(1)]) == (0, 1, -1)
    vix = spark.createDataFrame([(day(1), 1.0), (day(3), None)], "date date, value double")
    flow = spark.createDataFrame([(day(2), -1.0)], "date date, value double")
    got = {r["date"]: round(r["regime"], 6) for r in verdicts.regime_blend(bars, {"vix_score": vix, "flow": flow}).where(F.col("date") < day(4)).collect()}
    assert got == {day(0): 0.0, day(1): 0.3, day(2): 0.15, day(3): -0.15}
    ruin = verdicts.compared(spark.createDataFrame([("a", day(0), 100.0, 1), ("a", day(1), 1e-9, 1)], "symbol string, date date, close double, s int"), {"s": "s"}).first()
    assert (ruin["log_ret"], ruin["max_drawdown"], ruin["held"]) == (None, -1.0, 1)


def test_index_reversion_needs_fifty_bars(spark):
    bars = spark.createDataFrame([("i", day(k), 100.0 + (k % 3) if k < 59 else 60.0) for k in range(60)] + [("flat", day(k), 5.0) for k in range(50)], "symbol string, date date, close double")
    got = {(r["symbol"], r["date"]): r for r in verdicts.index_reversion(bars).collect()}
    assert len(got) == 12 and got["i", day(59)]["signal"] == "OVERSOLD_BUY" and got["i", day(59)]["strength"] == 1.0
    flat = got["flat", day(49)]
    assert (flat["z20"], flat["band"], round(flat["rsi"], 4)) == (0.0, 0.5, round(100 - 100 / 101, 4))


def test_replies(spark):
    texts = {'{"score": 0.5}': 0.5, '{"score": "-0.25", "x": 1}': -0.25, 'Well {"a": 1, "score": .75} so': 0.75, "about -0.3 or 0.9": -0.3, "none": None, '{"score": 3}': None, '{"score": 3} or 0.5': None, "": None, "7 of 0.5": None, '{"score": null} 0.5': 0.5, "[0.4]": 0.4}
    d = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r["t"]: r["s"] for r in d.select("t", sentiment.reply_score(F.col("t")).alias("s")).collect()}
    assert got == {**texts, None: None}
    batch = [
        (1, '{"scores": [{"i": 1, "score": 0.5}, {"i": 0, "score": 2}, {"i": 9, "score": 0.1}, {"i": "x", "score": 0.1}]}', 3), (2, 'Sure:\n{"scores": [{"i": 0, "score": "0.25"}, {"i": 0, "score": -1}]}\nbye', 1),
        (3, "no", 2), (4, None, 1), (5, '{"scores": 3}', 1), (6, "x", 0),
    ]
    got = {(r["k"], r["i"]): r["score"] for r in sentiment.batch_scores(spark.createDataFrame(batch, "k int, text string, expected int")).collect()}
    assert got == {(1, 0): None, (1, 1): 0.5, (1, 2): None, (2, 0): -1.0, (3, 0): None, (3, 1): None, (4, 0): None, (5, 0): None}


def test_chain_daily_features_and_summary(spark):
    rows = spark.createDataFrame([("a", day(0), "s1", None, 5.0), ("a", day(0), "s0", 0.2, None), ("a", day(1), "", -0.4, 0.1), ("b", day(0), "s1", None, None)], "symbol string, date date, source string, x double, y double")
    scored = sentiment.chain_scores(rows, [("first", F.col("x"), -0.3, 0.3), ("second", F.col("y"), -1.0, 1.0)])
    assert sorted((r["symbol"], r["source"], r["score"], r["scorer"]) for r in scored.where("score is not null").collect()) == [("a", "", -0.3, "first"), ("a", "s0", 0.2, "first"), ("a", "s1", 1.0, "second")]
    daily = sentiment.daily_sentiment(scored)
    assert {(r["symbol"], r["date"]): (r["sent_score"], r["n_articles"], r["sources"]) for r in daily.collect()} == {("a", day(0)): (0.6, 2, "s0,s1"), ("a", day(1)): (-0.3, 1, "")}
    got = {r["date"]: r for r in sentiment.sentiment_features(daily).collect()}[day(1)]
    assert (got["sent_24h"], got["sent_5d"], got["sent_momentum"]) == (-0.3, 0.15, -0.45)
    assert got["sent_n_5d"] == pytest.approx(2 * math.log1p(3) / math.log1p(50) - 1, abs=1e-4)
    odd = spark.createDataFrame([("n", day(0), None, 0), ("m", day(0), 0.5, 9999)], "symbol string, date date, sent_score double, n_articles long")
    odd = {r["symbol"]: (r["sent_24h"], r["sent_5d"], r["sent_momentum"], r["sent_n_5d"]) for r in sentiment.sentiment_features(odd).collect()}
    assert odd == {"n": (None, None, None, -1.0), "m": (0.5, 0.5, 0.0, 1.0)}
    symbols = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "symbol string")
    assert {r["symbol"]: r["sentiment"] for r in sentiment.sentiment_factor(symbols, sentiment.sentiment_features(daily)).collect()} == {"a": -0.3, "b": 0.0, "c": 0.0}
    assert {r["symbol"]: (r["articles"], r["scored"], r["days"], r["status"]) for r in sentiment.sentiment_summary(symbols, scored, daily).collect()} == {"a": (3, 3, 2, "ok"), "b": (1, 0, 0, "no_scores"), "c": (0, 0, 0, "no_articles")}


def test_articles_by_url_or_title(spark):
    shape = "symbol string, ts timestamp, source string, url string, title string"
    at = dt.datetime(2024, 1, 1)
    one = spark.createDataFrame([("a", at, "one", "u1", "t1"), ("a", at, "one", " ", "t2"), ("b", at, "one", "u1", "t1")], shape)
    two = spark.createDataFrame([("a", at, "two", "u1", "other"), ("a", at, "two", None, "t2"), ("a", at, "two", "u9", "t1"), ("a", at, "two", "", "t3"), ("a", at, "two", "", "t3")], shape)
    got = sorted((r["symbol"], r["source"], r["url"] or "", r["title"]) for r in sentiment.distinct_articles(one, two).collect())
    assert got == [("a", "one", " ", "t2"), ("a", "one", "u1", "t1"), ("a", "two", "", "t3"), ("a", "two", "u9", "t1"), ("b", "one", "u1", "t1")]


def test_condors_open_and_settle(spark):
    expiry, opened = day(30), day(0)
    legs = [(1, "CE", 110.0, 20.0, 0.26), (2, "CE", 120.0, 22.0, 0.11), (3, "PE", 90.0, 21.0, -0.25), (4, "PE", 80.0, 24.0, -0.09), (5, "CE", 100.0, 0.0, 0.25), (6, "PE", 70.0, 20.0, None)]
    rows = [("n", expiry, *x) for x in legs] + [("thin", expiry, *x) for x in legs[:2]] + [("flat", expiry, 1, "CE", 110.0, 20.0, 0.2), ("flat", expiry, 2, "PE", 90.0, 20.0, -0.2)] + [("blind", expiry, *x) for x in legs]
    chain = spark.createDataFrame(rows, "name string, expiry date, option_id int, option_type string, strike double, iv double, delta double")
    spots = spark.createDataFrame([(n, day(k), c) for n in ("n", "thin", "flat") for k, c in ((-2, 100.0), (29, 500.0), (32, 115.0), (33, 60.0))], "name string, date date, close double")
    got = {r["name"]: r for r in options.open_condors(chain, str(opened), spots).collect()}
    assert {n: r["status"] for n, r in got.items()} == {"n": "open", "thin": "thin", "flat": "degenerate", "blind": "no_spot"}

    def price(kind, k, iv, t=30 / 365, s=100.0, r=0.065):
        cdf = statistics.NormalDist().cdf
        d1 = (math.log(s / k) + (r + (iv / 100) ** 2 / 2) * t) / (iv / 100 * math.sqrt(t))
        d2 = d1 - iv / 100 * math.sqrt(t)
        return s * cdf(d1) - k * math.exp(-r * t) * cdf(d2) if kind == "CE" else k * math.exp(-r * t) * cdf(-d2) - s * cdf(-d1)

    credit = price("CE", 110, 20) + price("PE", 90, 21) - price("CE", 120, 22) - price("PE", 80, 24)
    n = got["n"]
    assert (n["short_call_strike"], n["long_call_strike"], n["short_put_strike"], n["long_put_strike"], n["days"]) == (110, 120, 90, 80, 30)
    assert n["credit"] == pytest.approx(credit, abs=0.006) and n["max_loss"] == pytest.approx((10 - credit) * 75, abs=1)
    opened_rows = options.open_condors(chain, str(opened), spots)
    early = options.settled_condors(opened_rows, spots, str(day(31))).first()
    assert (early["status"], early["profit"]) == ("open", None)  # due, but there is no close on or after the expiry yet
    late = options.settled_condors(opened_rows, spots, str(day(40))).first()
    assert (late["status"], late["settle_date"], late["settle_spot"]) == ("settled", day(32), 115.0) and late["points"] == pytest.approx(n["credit"] - 5)
    book = {r["name"]: (r["positions"], r["settled"], r["winners"]) for r in options.condor_book(options.settled_condors(opened_rows, spots, str(day(40)))).collect()}
    assert book == {"n": (1, 1, 0), "TOTAL": (1, 1, 0)}


def test_tranches(spark):
    plans = spark.createDataFrame([
        ("s", 1, 4, 31, dt.date(2024, 1, 15)), ("s", 2, 2, 10, None), ("s", 3, 1, 5, dt.date(2024, 1, 1)), ("s", 4, 12, 20, dt.date(2024, 6, 1)), ("s", 5, 3, 29, None),
    ], "sleeve string, instrument int, tranches int, day_of_month int, started date")
    trades = spark.createDataFrame([("s", 1, "BUY", 10.0, 5.0, 2.0), ("s", 1, "SELL", 10.0, 9.0, 0.0), ("s", 3, "BUY", 1.0, 7.0, None)], "sleeve string, instrument int, side string, qty double, price double, fees double")
    got = {r["instrument"]: (r["done"], r["complete"], r["avg_entry"], r["expected"], r["overdue"], r["next_due"]) for r in fund.tranche_status(plans, trades, "2024-02-29").collect()}
    assert got[1] == (1, False, 5.2, 2, 1, dt.date(2024, 2, 29))  # the 31st of February is its last day, due today
    assert got[2] == (0, False, None, 0, 0, dt.date(2024, 3, 10)) and got[5] == (0, False, None, 0, 0, dt.date(2024, 2, 29))
    assert got[3] == (1, True, 7.0, 1, 0, None) and got[4] == (0, False, None, 0, 0, dt.date(2024, 6, 20))
