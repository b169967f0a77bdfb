"""Equity curves of signal tables and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import by_symbol, change, norm_cdf

C = F.col


def equity(signals: DataFrame, cost: float = 0.0015) -> DataFrame:
    """Long-only: yesterday's signal is today's position, a change of it costs. (symbol, date, close, signal) for all symbols in one plan."""
    pos = F.coalesce(F.greatest(F.lag("signal").over(by_symbol()), F.lit(0)), F.lit(0))
    d = signals.select("symbol", "date", "close", pos.alias("position"), F.coalesce(change(C("close"), 1), F.lit(0.0)).alias("ret"))
    d = d.withColumn("traded", F.abs(C("position") - F.coalesce(F.lag("position").over(by_symbol()), F.lit(0)))).withColumn("net", C("position") * C("ret") - cost * C("traded"))
    run = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(run))).withColumn("hold", F.exp(F.sum(F.log1p("ret")).over(run)))
    return d.withColumn("drawdown", C("equity") / F.max("equity").over(run) - 1).select("symbol", "date", "position", "net", "equity", "hold", "drawdown")


def trades(curve: DataFrame) -> DataFrame:
    """Round trips: runs of held bars; a run that reaches the last bar is closed there."""
    start = F.when((C("position") == 1) & (F.coalesce(F.lag("position").over(by_symbol()), F.lit(0)) == 0), 1).otherwise(0)
    d = curve.withColumn("_s", start).withColumn("trade", F.sum("_s").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).where("position = 1")
    return d.groupBy("symbol", "trade").agg(F.min("date").alias("entry_date"), F.max("date").alias("exit_date"), F.count(F.lit(1)).alias("bars"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("ret"))


def statistics(curve: DataFrame, riskfree: float = 0.06, periods: int = 252) -> DataFrame:
    """CAGR, Sharpe, Sortino, worst drawdown and Calmar by symbol."""
    ex = C("net") - riskfree / periods
    g = curve.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log1p("net")).alias("_l"), F.datediff(F.max("date"), F.min("date")).alias("_days"), F.avg(ex).alias("_m"), F.stddev_samp("net").alias("_s"), F.sqrt(F.avg(F.when(ex < 0, ex * ex))).alias("_d"), F.min("drawdown").alias("max_drawdown"))
    g = g.withColumn("cagr", F.when(C("_days") > 0, F.exp(C("_l") * 365.25 / C("_days")) - 1))
    return g.select("symbol", "n", "cagr", F.when(C("_s") > 0, C("_m") / C("_s") * F.sqrt(F.lit(float(periods)))).alias("sharpe"), F.when(C("_d") > 0, C("_m") / C("_d") * F.sqrt(F.lit(float(periods)))).alias("sortino"), "max_drawdown", F.when(C("max_drawdown") < 0, C("cagr") / F.abs("max_drawdown")).alias("calmar"))


def trade_statistics(trips: DataFrame) -> DataFrame:
    win, loss = F.when(C("ret") > 0, C("ret")), F.when(C("ret") < 0, -C("ret"))
    return trips.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.avg((C("ret") > 0).cast("double")).alias("win_rate"), F.avg(win).alias("avg_win"), F.avg(-loss).alias("avg_loss"), F.when(F.sum(loss) > 0, F.least(F.sum(win) / F.sum(loss), F.lit(99.9))).when(F.max("ret") > 0, 99.9).otherwise(0.0).alias("profit_factor"))


def probabilistic_sharpe(returns: DataFrame, by: str, value: str, benchmark: float = 0.0) -> DataFrame:
    """Probability that the true Sharpe ratio (per period) exceeds ``benchmark``, by skewness and kurtosis of the returns."""
    g = returns.where(C(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.avg(value) / F.stddev_samp(value)).alias("sr"), F.skewness(value).alias("g3"), (F.kurtosis(value) + 3).alias("g4"))
    return g.select(by, "n", "sr", norm_cdf((C("sr") - benchmark) * F.sqrt(C("n") - 1) / F.sqrt(F.greatest(1 - C("g3") * C("sr") + (C("g4") - 1) / 4 * C("sr") * C("sr"), F.lit(1e-12)))).alias("psr"))


def overfitting_probability(returns: DataFrame, slices: int = 8) -> DataFrame:
    """Probability of backtest overfitting over all choices of half the slices.

    ``returns``: (period long from 0 without gaps, strategy, ret). A slice is kept as count, sum and sum of squares, so a choice
    costs one row by strategy and slice. Per choice the best strategy inside is ranked outside; the result is the share of
    choices where it lands in the lower half.
    """
    from itertools import combinations

    last = returns.groupBy().agg((F.max("period") + 1).alias("n"))
    d = returns.crossJoin(F.broadcast(last)).withColumn("slice", F.floor(C("period") * slices / C("n")).cast("int"))
    m = d.groupBy("strategy", "slice").agg(F.count("ret").alias("k"), F.sum("ret").alias("s"), F.sum(C("ret") * C("ret")).alias("q"))
    picks = returns.sparkSession.createDataFrame([(i, s, s in c) for i, c in enumerate(combinations(range(slices), slices // 2)) for s in range(slices)], "choice int, slice int, inside boolean")
    g = m.join(F.broadcast(picks), "slice").groupBy("choice", "inside", "strategy").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = C("s") / C("k")
    g = g.withColumn("sharpe", F.try_divide(mean, F.sqrt(F.greatest(C("q") / C("k") - mean * mean, F.lit(0.0)))))
    best = g.where("inside").groupBy("choice").agg(F.max_by("strategy", F.struct("sharpe", "strategy")).alias("strategy"))
    out = g.where("not inside").withColumn("rank", F.rank().over(Window.partitionBy("choice").orderBy("sharpe"))).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("choice")))
    r = out.join(best, ["choice", "strategy"]).withColumn("w", C("rank") / (C("of") + 1))
    return r.agg(F.avg((C("w") <= 0.5).cast("double")).alias("pbo"), F.avg(F.ln(C("w") / (1 - C("w")))).alias("mean_logit"), F.count(F.lit(1)).alias("choices"))


def dial(scores: DataFrame, lags: tuple[int, ...] = (1, 2), cash: tuple[float, ...] = (0.0, 0.06), cost: float = 0.0005) -> DataFrame:
    """Exposure 0.5 + score, clipped to [0, 1] and lagged; the rest earns cash; changes cost. All settings in one pass. (symbol, date, close, score)."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + C("score")))
    d = scores.select("symbol", "date", F.coalesce(change(C("close"), 1), F.lit(0.0)).alias("r"), *(F.coalesce(F.lag(w, k).over(by_symbol()), F.lit(0.0)).alias(f"w{k}") for k in lags))
    long = d.select("symbol", "date", "r", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), C(f"w{k}").alias("w")) for k in lags))).alias("x")).select("symbol", "date", "r", "x.*")
    turn = F.abs(C("w") - F.coalesce(F.lag("w").over(Window.partitionBy("symbol", "lag").orderBy("date")), F.lit(0.0)))
    d = long.withColumn("turn", turn).withColumn("cash", F.explode(F.array(*map(F.lit, cash)))).withColumn("net", C("w") * C("r") + (1 - C("w")) * C("cash") / 252 - C("turn") * cost)
    g = d.groupBy("symbol", "lag", "cash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log1p("net")).alias("_l"), F.datediff(F.max("date"), F.min("date")).alias("_days"), (F.avg("net") * 252).alias("mean"), (F.stddev_samp("net") * F.sqrt(F.lit(252.0))).alias("vol"))
    return g.select("symbol", "lag", "cash", "n", (F.exp(C("_l") * 252 / C("n")) - 1).alias("cagr"), "mean", "vol")
