"""Rolling and exponentially weighted indicators over bars (symbol, date, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.ewm import ewm_mean
from marlstone.functions.expr import by_symbol, change, forward, over_rows, rolling

C = F.col


def returns(bars: DataFrame, back: tuple[int, ...] = (1, 5, 21), ahead: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Simple, log and forward returns."""
    cols = [change(C("close"), k).alias(f"r{k}") for k in back] + [forward(C("close"), k).alias(f"fwd{k}") for k in ahead]
    before = F.lag("close").over(by_symbol())
    log = F.when((C("close") > 0) & (before > 0), F.ln(C("close") / before)).alias("log_r1")
    return bars.select("symbol", "date", "close", *cols, log)


def sma_bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Mean, sample and population deviations, bands, %B, band width and z-score."""
    mid, std, pop = rolling(F.avg, C("close"), n), rolling(F.stddev_samp, C("close"), n), rolling(F.stddev_pop, C("close"), n)
    d = bars.select("symbol", "date", "close", mid.alias("mid"), std.alias("std"), pop.alias("pop"))
    up, low = C("mid") + width * C("std"), C("mid") - width * C("std")
    return d.select(
        "symbol", "date", "close", "mid", up.alias("upper"), low.alias("lower"),
        F.when(C("std") > 0, (C("close") - low) / (up - low)).alias("pct_b"),
        (2 * width * C("pop") / C("mid") * 100).alias("bandwidth"),
        F.when(C("std") > 0, (C("close") - C("mid")) / C("std")).otherwise(F.when(C("std").isNotNull(), 0.0)).alias("z"),
    )


def drawdown_equity(bars: DataFrame) -> DataFrame:
    """Growth of 1 since the first bar, running peak and drawdown."""
    first = F.first("close").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    d = bars.select("symbol", "date", (C("close") / first).alias("equity"))
    peak = F.max("equity").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("peak", peak).withColumn("drawdown", C("equity") / C("peak") - 1)


def rsi_ewm(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI from exponentially weighted mean gains and losses (com n - 1, adjusted)."""
    d = bars.withColumn("_d", C("close") - F.lag("close").over(by_symbol()))
    d = d.withColumn("gain", F.when(C("_d").isNotNull(), F.greatest(C("_d"), F.lit(0.0)))).withColumn("loss", F.when(C("_d").isNotNull(), F.greatest(-C("_d"), F.lit(0.0))))
    d = ewm_mean(ewm_mean(d, "gain", "avg_gain", 1 / n, True, n), "loss", "avg_loss", 1 / n, True, n)
    return d.select("symbol", "date", "close", F.when(C("avg_loss") == 0, 100.0).otherwise(100 - 100 / (1 + C("avg_gain") / C("avg_loss"))).alias("rsi"))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Line, signal, histogram and the crossing of the histogram's sign."""
    d = ewm_mean(ewm_mean(bars, "close", "fast", 2 / (fast + 1), False), "close", "slow", 2 / (slow + 1), False)
    d = ewm_mean(d.withColumn("macd", C("fast") - C("slow")), "macd", "signal", 2 / (signal + 1), False)
    d = d.withColumn("hist", C("macd") - C("signal"))
    before = F.lag("hist").over(by_symbol())
    cross = F.when((before <= 0) & (C("hist") > 0), "bullish").when((before >= 0) & (C("hist") < 0), "bearish").otherwise("none")
    return d.select("symbol", "date", "close", "macd", "signal", "hist", cross.alias("crossing"))


def atr_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    """Average true range as an exponentially weighted mean of weight 1/n; the first true range has no close before it."""
    before = F.lag("close").over(by_symbol())
    tr = F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before))
    return ewm_mean(bars.withColumn("tr", tr), "tr", "atr", 1 / n, False, n).select("symbol", "date", "tr", "atr")


def hysteresis(bars: DataFrame, n: int = 20, enter: float = -1.5, leave: float = 0.0) -> DataFrame:
    """1 from a z-score below ``enter`` until one of ``leave`` or more: the last decision that isn't null."""
    z = (C("close") - rolling(F.avg, C("close"), n)) / rolling(F.stddev_samp, C("close"), n)
    d = bars.select("symbol", "date", z.alias("z"))
    state = F.last(F.when(C("z") < enter, 1).when(C("z") >= leave, 0), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("state", F.coalesce(state, F.lit(0)))


def streaks(bars: DataFrame) -> DataFrame:
    """Length of the run of rises or falls that each bar stands in."""
    move = F.signum(C("close") - F.lag("close").over(by_symbol())).cast("int")
    d = bars.select("symbol", "date", F.coalesce(move, F.lit(0)).alias("move"))
    new = F.when(C("move") == F.lag("move").over(by_symbol()), 0).otherwise(1)
    d = d.withColumn("_new", new).withColumn("run", F.sum("_new").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("streak", F.row_number().over(Window.partitionBy("symbol", "run").orderBy("date")).cast("long")).select("symbol", "date", "move", "streak")


def percentile_of_last(x: str, n: int, least: int, window) -> Column:
    """Share of the last n values that the current one reaches, ties at their mean rank."""
    a = F.collect_list(x).over(over_rows(n, window))
    return F.when((F.size(a) >= least) & C(x).isNotNull(), (F.size(F.filter(a, lambda v: v < C(x))) + (F.size(F.filter(a, lambda v: v == C(x))) + 1) / F.lit(2.0)) / F.size(a))


def seeded(df: DataFrame, value: str, out: str, n: int, alpha: float) -> DataFrame:
    """The recurrence y = y + alpha (x - y), started with the plain mean of the first n values that aren't null."""
    k = F.count(value).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    mean = F.avg(value).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("_x", F.when(k == n, mean).when(k > n, C(value)))
    return ewm_mean(d, "_x", out, alpha, False).drop("_x")


def ema_seeded(bars: DataFrame, n: int = 20) -> DataFrame:
    return seeded(bars, "close", "ema", n, 2 / (n + 1)).select("symbol", "date", "close", "ema")


def rsi_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI in the textbook form: mean gains and losses of n bars start Wilder's smoothing; without losses it is 100."""
    d = bars.withColumn("_d", C("close") - F.lag("close").over(by_symbol()))
    d = d.withColumn("gain", F.when(C("_d").isNotNull(), F.greatest(C("_d"), F.lit(0.0)))).withColumn("loss", F.when(C("_d").isNotNull(), F.greatest(-C("_d"), F.lit(0.0))))
    d = seeded(seeded(d, "gain", "g", n, 1 / n), "loss", "l", n, 1 / n)
    return d.select("symbol", "date", "close", F.when(C("l") == 0, 100.0).otherwise(100 - 100 / (1 + C("g") / C("l"))).alias("rsi"))
