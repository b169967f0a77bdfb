"""Verdicts from weighted sub-scores, price targets, the signals log, the queue of signals and its gap check."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import by_symbol, clip, rolling
from marlstone.operators.align import asof
from marlstone.operators.factors import LONG, SHORT
from marlstone.operators.features import LINEAR

C = F.col
# Weights of the sub-scores, in the order in which reasons name them; the two flow scores only vote.
WEIGHTS = {
    "composite_factor": 0.14, "rsi": 0.09, "macd": 0.09, "trend_ma": 0.08, "bollinger": 0.07, "volume": 0.05, "volatility": 0.04, "relative_strength": 0.06,
    "sector_rotation": 0.05, "analyst_consensus": 0.03, "vix_regime": 0.04, "nifty_trend": 0.04, "markov_regime": 0.04, "fii_flow_score": 0.0, "fii_fo_score": 0.0,
    "valuation": 0.08, "financial_health": 0.06, "growth": 0.04,
}
BUY, SELL, LEAST_BARS, REASON = 0.35, -0.35, 30, 0.1
# Fixed values: (column, middle, scale) of the ratios behind each fundamental score; those marked True count only above zero.
VALUATION = [("pe_ratio", 20, -15.0, True), ("pb_ratio", 3, -3.0, True), ("price_to_sales", 3, -5.0, True)]
HEALTH = [("current_ratio", 1.5, 1.0, False), ("debt_to_equity", 1.0, -1.0, False), ("interest_coverage", 3.0, 4.0, True)]
GROWTH = [("revenue_growth_5y", 0, 15.0, False), ("eps_growth_5y", 0, 15.0, False), ("revenue_growth_3y", 0, 15.0, False), ("eps_growth_3y", 0, 15.0, False)]
MOST_GAP = 3.0


def _mean_of_known(parts: list[Column]) -> Column:
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.0)


def fundamental_scores(financials: DataFrame) -> DataFrame:
    """(symbol, valuation, financial_health, growth): each the mean of its parts that are known, cut to [-1, 1]; 0 without any. A column that the table lacks is not known."""
    have = set(financials.columns)

    def part(name: str, middle: float, scale: float, positive: bool) -> list[Column]:
        if name not in have:
            return []
        score = clip((C(name) - middle) / scale, -1, 1)
        return [F.when(C(name) > 0, score) if positive else score]

    value, health, growth = ([p for x in rows for p in part(*x)] for rows in (VALUATION, HEALTH, GROWTH))
    if "free_cash_flow" in have:
        health.append(F.when(C("free_cash_flow") > 0, 0.5).when(C("free_cash_flow").isNotNull(), -0.5))
    if {"net_margin_ttm", "net_margin_5y"} <= have:
        growth.append(clip(F.try_divide(C("net_margin_ttm") - C("net_margin_5y"), F.abs("net_margin_5y")) / 0.3, -1, 1))
    nothing = [F.lit(None).cast("double")]
    return financials.select("symbol", *(_mean_of_known(x or nothing).alias(k) for k, x in (("valuation", value), ("financial_health", health), ("growth", growth))))


def analyst_consensus(ratings: DataFrame) -> DataFrame:
    """(symbol, analyst_consensus): strong buys and buys less sells and strong sells, over all ratings; symbols without ratings are left out."""
    n = {c: F.coalesce(C(c), F.lit(0)) for c in ("strong_buy", "buy", "hold", "sell", "strong_sell")}
    total = reduce(lambda a, b: a + b, n.values())
    return ratings.where(total > 0).select("symbol", ((n["strong_buy"] + n["buy"] - n["sell"] - n["strong_sell"]) / total).alias("analyst_consensus"))


def peer_rotation(bars: DataFrame, bench: DataFrame, sector_of: DataFrame, n: int = 20, most: int = 20) -> DataFrame:
    """(symbol, sector_rotation): mean return over the last n bars of the first ``most`` other symbols of the sector, less the benchmark's, over 0.2, cut.

    Peers stand in order of symbol; those with fewer than n bars have no return, and a symbol without any such peer gets 0. A sector's sums over its first
    ``most`` and ``most`` + 1 members serve all of its symbols, so no pairs are made.
    """
    last = Window.partitionBy("symbol").orderBy(F.desc("date"))
    ret = lambda d: d.withColumn("_k", F.row_number().over(last)).where(C("_k").isin(1, n)).groupBy("symbol").agg((F.max(F.when(C("_k") == 1, C("close"))) / F.max(F.when(C("_k") == n, C("close"))) - 1).alias("r"))
    market = ret(bench.select(F.lit(0).alias("symbol"), "date", "close")).select(F.max("r").alias("market"))  # one row, whatever there is
    members = sector_of.select("symbol", "sector").join(ret(bars), "symbol", "left").withColumn("_i", F.row_number().over(Window.partitionBy("sector").orderBy("symbol")))
    upto = lambda k, fn, x: fn(F.when(C("_i") <= k, x))
    sums = members.where(C("_i") <= most + 1).groupBy("sector").agg(upto(most, F.sum, C("r")).alias("s0"), upto(most, F.count, C("r")).alias("n0"), F.sum("r").alias("s1"), F.count("r").alias("n1"))
    own, counted = F.coalesce(C("r"), F.lit(0.0)), C("r").isNotNull().cast("int")
    inside = C("_i") <= most
    mean = F.try_divide(F.when(inside, F.coalesce("s1", F.lit(0.0)) - own).otherwise(C("s0")), F.when(inside, C("n1") - counted).otherwise(C("n0")).cast("double"))
    score = clip((mean - F.coalesce("market", F.lit(0.0))) / 0.2, -1, 1)
    return members.join(F.broadcast(sums), "sector").crossJoin(F.broadcast(market)).select("symbol", F.coalesce(score, F.lit(0.0)).alias("sector_rotation"))


def levels(bars: DataFrame) -> DataFrame:
    """(symbol, date, close, data_points, sma20, sma50, upper, lower) of every bar; a level without enough bars is null."""
    mid, std = rolling(F.avg, C("close"), 20), rolling(F.stddev_samp, C("close"), 20)
    return bars.select("symbol", "date", "close", F.row_number().over(by_symbol()).alias("data_points"), mid.alias("sma20"), rolling(F.avg, C("close"), 50).alias("sma50"), (mid + 2 * std).alias("upper"), (mid - 2 * std).alias("lower"))


def entry_target(price: Column, sma20: Column, lower: Column) -> Column:
    """Half-way between lower band and mean, no higher than the price and no more than 5 % below it; without levels 1 % below it."""
    known = F.greatest(F.least(price, (lower + sma20) / 2), price * 0.95)
    return F.round(F.when(sma20.isNull() | lower.isNull(), price * 0.99).otherwise(known), 2)


def exit_target(price: Column, sma20: Column, upper: Column) -> Column:
    known = F.least(F.greatest(price, (upper + sma20) / 2), price * 1.05)
    return F.round(F.when(sma20.isNull() | upper.isNull(), price * 1.01).otherwise(known), 2)


def verdicts(rows: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds score, verdict, confidence, method, target, target_type and reasoning to rows of ``levels`` with the sub-scores in ``weights`` and, if a model
    scored them, ml_verdict and ml_confidence.

    Sub-scores count rounded to four places, unknown ones as 0. A model's verdict goes before the weighted sum's. Confidence of the sum is the share of
    sub-scores of its sign. Rows with fewer than 30 bars get INSUFFICIENT_DATA, score and confidence 0 and no target.
    """
    value = {k: F.round(F.coalesce(C(k), F.lit(0.0)), 4).cast("decimal(10,4)") for k in weights}  # exact, as sums of four places times two often end in a five
    total = reduce(lambda a, b: a + b, (value[k] * F.lit(Decimal(str(w)).quantize(Decimal("0.0001"))) for k, w in weights.items()))
    votes = F.array(*value.values())
    sign = F.signum(C("score"))
    agreeing = F.size(F.filter(votes, lambda v: F.signum(v) == sign))
    linear = F.when(C("score") >= BUY, "BUY").when(C("score") <= SELL, "SELL").otherwise("HOLD")
    modelled = C("ml_verdict").isNotNull() if "ml_verdict" in rows.columns else F.lit(False)
    by_model = lambda column, otherwise: F.when(modelled, C(column)).otherwise(otherwise) if "ml_verdict" in rows.columns else otherwise
    title = lambda k: k.replace("_", " ").title()
    names = lambda ok: F.concat_ws(", ", *(F.when(ok(v), F.lit(title(k))) for k, v in value.items()))
    up, down = names(lambda v: v > REASON), names(lambda v: v < -REASON)
    parts = F.concat_ws(" | ", F.when(up != "", F.concat(F.lit("Bullish: "), up)), F.when(down != "", F.concat(F.lit("Bearish: "), down)))
    enough = C("data_points") >= LEAST_BARS
    d = rows.withColumn("score", F.round(F.greatest(F.lit(Decimal(-1)), F.least(F.lit(Decimal(1)), total)), 4).cast("double"))
    d = d.withColumn("verdict", by_model("ml_verdict", linear)).withColumn("confidence", by_model("ml_confidence", F.round(agreeing / F.lit(len(weights)) * 100, 1)))
    target = F.when(C("verdict") == "BUY", entry_target(C("close"), C("sma20"), C("lower"))).when(C("verdict") == "SELL", exit_target(C("close"), C("sma20"), C("upper"))).otherwise(F.round("close", 2))
    kind = F.when(C("verdict") == "BUY", "entry").when(C("verdict") == "SELL", "exit").otherwise("fair_value")
    reasoning = F.when(parts != "", parts).otherwise("Signals are mixed, no strong conviction")
    d = d.withColumns({"method": F.when(modelled, "model").otherwise("linear"), "target": F.when(enough, target), "target_type": F.when(enough, kind), "reasoning": F.when(enough, reasoning).otherwise("Not enough price data")})
    return d.withColumns({"score": F.when(enough, C("score")).otherwise(0.0), "confidence": F.when(enough, C("confidence")).otherwise(0.0), "verdict": F.when(enough, C("verdict")).otherwise("INSUFFICIENT_DATA")})


def ranked(judged: DataFrame) -> DataFrame:
    """Rows with their rank by score (ties by symbol) and how many rows share their verdict. Of one row a symbol."""
    order = Window.orderBy(F.desc("score"), "symbol")
    return judged.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("same_verdict", F.count(F.lit(1)).over(Window.partitionBy("verdict")))


def latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "symbol")), "date").alias("_r")).select("symbol", "_r.*")


def linear_log(scored: DataFrame, weights: dict[str, float] = LINEAR, least: int = LEAST_BARS) -> DataFrame:
    """(symbol, date, composite, linear_signal) of every bar of symbols with ``least`` bars: the weighted factors on a scale of 100."""
    total = clip(reduce(lambda a, b: a + b, (C(k) * w for k, w in weights.items())), -1, 1) * 100
    label = F.when(C("composite") >= LONG, "LONG").when(C("composite") <= SHORT, "SHORT").otherwise("HOLD")
    d = scored.select("symbol", "date", total.alias("composite"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("_n"))
    return d.where((C("_n") >= least) & C("composite").isNotNull()).drop("_n").withColumn("linear_signal", label)


def backfilled(linear: DataFrame, model: DataFrame) -> DataFrame:
    """(symbol, date, signal, composite, ml_confidence, linear_signal): the out-of-sample verdict of (symbol, date, ml_verdict, ml_confidence) where there is
    one, else the linear label. Model rows without a linear row are left out; of repeated model rows the surest counts."""
    m = model.groupBy("symbol", "date").agg(F.max(F.struct("ml_confidence", "ml_verdict")).alias("_m"))
    d = linear.join(m, ["symbol", "date"], "left")
    known = C("_m.ml_verdict").isNotNull()
    return d.select("symbol", "date", F.coalesce("_m.ml_verdict", "linear_signal").alias("signal"), "composite", F.when(known, C("_m.ml_confidence")).alias("ml_confidence"), "linear_signal")


def merged_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with the named columns of ``rows`` set, nulls too, by (symbol, date); other columns of an old row stay. Rows without model and linear signal go."""
    keys, named = ["symbol", "date"], [c for c in rows.columns if c not in ("symbol", "date")]
    new = rows.select(*keys, F.struct(*named).alias("_new"))
    d = log.join(new, keys, "full_outer")
    keep = [F.when(C("_new").isNotNull(), C(f"_new.{c}")).otherwise(C(c)).alias(c) if c in named else C(c) for c in log.columns if c not in keys]
    return d.select(*keys, *keep).where("ml_confidence is not null or linear_signal is not null")


def next_weekday(day: Column) -> Column:
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def signal_queue(judged: DataFrame) -> DataFrame:
    """Rows that passed every gate (``signals.conviction``), as signals to execute on the next weekday."""
    source = F.when(C("ml_path"), "MODEL").otherwise("LINEAR")
    return judged.where("passed").select("symbol", C("date").alias("signal_date"), next_weekday(C("date")).alias("execute_on"), F.lit("BUY").alias("signal"), C("close").alias("signal_price"), "composite", source.alias("source"), F.lit("pending").alias("status"))


def skipped(judged: DataFrame) -> DataFrame:
    """A row a failed gate of every row that isn't queued: its name, value and what it requires."""
    gate = F.explode(F.filter("gates", lambda g: ~g["ok"])).alias("g")
    return judged.where("not passed").select("symbol", "date", "composite", gate).select("symbol", "date", "composite", C("g.name").alias("gate"), C("g.value").alias("value"), C("g.required").alias("required"))


def gap_checked(queue: DataFrame, bars: DataFrame, most: float = MOST_GAP) -> DataFrame:
    """Pending signals against the last close at or before their day of execution: one further than ``most`` percent from the signal's price is rejected, one
    without a price too. Others than pending ones stay as they are, without price and gap."""
    d = asof(queue.withColumn("date", C("execute_on")), bars.select("symbol", "date", "close"), "close", ["symbol"], out="price").drop("date")
    pending = C("status") == "pending"
    gap = F.round(F.abs((C("price") - C("signal_price")) / C("signal_price")) * 100, 2)
    wide = F.abs(C("price") - C("signal_price")) * 100 > most * C("signal_price")
    reason = F.when(C("price").isNull() | (C("price") == 0), "no_current_price").when(wide, F.concat(F.lit("gap "), F.format_string("%.2f", gap), F.lit(f"% exceeds {most:g}% limit")))
    status = F.when(C("reason") == "no_current_price", "rejected_risk").when(C("reason").isNotNull(), "rejected_gap").otherwise(C("status"))
    d = d.withColumn("reason", F.when(pending, reason)).withColumn("gap_pct", F.when(pending, gap)).withColumn("price", F.when(pending, C("price")))
    return d.withColumn("status", status)


def index_reversion(bars: DataFrame, least: int = 50) -> DataFrame:
    """Deviations from the means of 20 and 50 bars, place in the band, simple relative strength, their blend and a signal, for every bar from the ``least``-th on."""
    from marlstone.operators.signals import rsi_simple

    mean = {n: rolling(F.avg, C("close"), n) for n in (20, 50)}
    std = {n: rolling(F.stddev_samp, C("close"), n) for n in (20, 50)}
    z = lambda n: F.when(std[n] > 0, (C("close") - mean[n]) / std[n]).otherwise(0.0)
    place = F.when(std[20] > 0, (C("close") - mean[20] + 2 * std[20]) / (4 * std[20])).otherwise(0.5)
    d = bars.select("symbol", "date", "close", F.row_number().over(by_symbol()).alias("_n"), z(20).alias("z20"), z(50).alias("z50"), place.alias("band"))
    d = d.join(rsi_simple(bars), ["symbol", "date"]).where(C("_n") >= least).drop("_n")
    d = d.withColumn("blend", (C("z20") * 0.6 + C("z50") * 0.4) / 2 * 0.4 + (C("band") - 0.5) * 2 * 0.3 + (C("rsi") - 50) / 50 * 0.3)
    signal = F.when((C("blend") < -0.3) & (C("rsi") < 35), "OVERSOLD_BUY").when((C("blend") > 0.3) & (C("rsi") > 65), "OVERBOUGHT_SELL")
    signal = signal.when(C("blend") < -0.15, "MILD_OVERSOLD").when(C("blend") > 0.15, "MILD_OVERBOUGHT").otherwise("NEUTRAL")
    return d.withColumn("signal", signal).withColumn("strength", F.least(F.abs("blend"), F.lit(1.0)))


# Weights of the market-wide scores, and the blend beyond which a market trends or falls back.
REGIME = {"vix_score": 0.30, "trend": 0.20, "markov": 0.20, "put_call": 0.15, "flow": 0.15}
TREND, REVERSION, ENTER, LEAVE, ACT = 0.15, -0.15, -1.5, 0.0, 0.40


def regime_blend(dates: DataFrame, series: dict[str, DataFrame], weights: dict[str, float] = REGIME) -> DataFrame:
    """(date, the series under the names in ``weights`` and regime) of each date: the last value at or before it, null and missing series as 0."""
    from marlstone.operators.features import market_calendar

    d = market_calendar(dates.select("date").distinct(), {k: series[k] for k in weights if k in series})
    d = d.select("date", *(F.coalesce(C(k), F.lit(0.0)).alias(k) if k in series else F.lit(0.0).alias(k) for k in weights))
    return d.join(dates.select("date").distinct(), "date").withColumn("regime", clip(reduce(lambda a, b: a + b, (C(k) * w for k, w in weights.items())), -1, 1))


def hold_signals(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "date", "close", F.lit(1).alias("signal"))


def linear_signals(scored: DataFrame, weights: dict[str, float] = LINEAR, act: float = ACT) -> DataFrame:
    """(symbol, date, close, signal) of scored bars: 1 from a weighted sum of ``act`` up, -1 from -``act`` down, else 0."""
    total = reduce(lambda a, b: a + b, (C(k) * w for k, w in weights.items()))
    return scored.select("symbol", "date", "close", F.when(total >= act, 1).when(total <= -act, -1).otherwise(0).alias("signal"))


def model_signals(linear: DataFrame, model: DataFrame, out: str = "signal") -> DataFrame:
    """Sets ``out`` by a model's verdicts (symbol, date, ml_verdict); symbols that no model scored follow the linear signal, unscored bars of the others are 0."""
    m = model.groupBy("symbol", "date").agg(F.max(F.when(C("ml_verdict").isin("BUY", "LONG"), 1).when(C("ml_verdict").isin("SELL", "SHORT"), -1).otherwise(0)).alias("_m"))
    scored = F.count("_m").over(Window.partitionBy("symbol")) > 0
    return linear.join(m, ["symbol", "date"], "left").withColumn("_s", scored).withColumn(out, F.when(C("_s"), F.coalesce("_m", F.lit(0))).otherwise(C("signal"))).drop("_m", "_s")


def reversion_signals(bars: DataFrame, n: int = 20, least: int = 10) -> DataFrame:
    """1 from a deviation below -1.5 until one of 0 or more; a deviation that isn't known counts as 0."""
    std = rolling(F.stddev_samp, C("close"), n, least)
    z = F.coalesce(F.when(std > 0, (C("close") - rolling(F.avg, C("close"), n, least)) / std), F.lit(0.0))
    d = bars.select("symbol", "date", "close", z.alias("_z"))
    state = F.last(F.when(C("_z") < ENTER, 1).when(C("_z") >= LEAVE, 0), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return d.select("symbol", "date", "close", F.coalesce(state, F.lit(0)).alias("signal"))


def adaptive_signals(linear: DataFrame, bars: DataFrame, regime: DataFrame, out: str = "signal") -> DataFrame:
    """Sets ``out`` to the linear signal where the regime is above 0.15, to that of reversion below -0.15, to cash between and where no regime is known."""
    back = reversion_signals(bars).select("symbol", "date", C("signal").alias("_back"))
    d = linear.join(back, ["symbol", "date"]).join(regime.select("date", C("regime").alias("_regime")), "date", "left")
    return d.withColumn(out, F.when(C("_regime") > TREND, C("signal")).when(C("_regime") < REVERSION, C("_back")).otherwise(0)).drop("_back", "_regime")


def compared(signals: DataFrame, strategies: dict[str, str], cost: float = 0.0015) -> DataFrame:
    """By strategy and symbol: bars, days held, logarithmic return of the strategy and of holding, worst drawdown. ``strategies`` names a
    signal column each. A bar that costs all or more ruins a strategy: its return is null then, its drawdown -1."""
    from marlstone.operators.backtest import equity

    each = F.explode(F.array(*(F.struct(F.lit(k).alias("strategy"), C(c).cast("int").alias("signal")) for k, c in strategies.items())))
    every = signals.select("symbol", "date", "close", each.alias("_x")).select(F.struct("_x.strategy", "symbol").alias("symbol"), "date", "close", "_x.signal")
    curve = equity(every, cost)
    g = curve.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.sum("position").cast("long").alias("held"), F.max_by("equity", "date").alias("_e"), F.max_by("hold", "date").alias("_h"), F.min("drawdown").alias("_d"), (F.min("net") <= -1).alias("_ruined"))
    return g.select("symbol.strategy", "symbol.symbol", "bars", "held", F.when(~C("_ruined"), F.ln("_e")).alias("log_ret"), F.ln("_h").alias("hold_log_ret"), F.when(C("_ruined"), -1.0).otherwise(C("_d")).alias("max_drawdown"))

