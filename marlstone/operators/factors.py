"""Factor scores on [-1, 1] for every bar, the composite of them, and regime scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import by_symbol, change, clip, rolling
from marlstone.operators.indicators import percentile_of_last

C = F.col
# Weights of the four factors, and the label thresholds on a scale of 100.
WEIGHTS = {"momentum": 0.4, "bollinger": 0.2, "volatility": 0.2, "volume": 0.2}
LONG, SHORT = 40, -40


def factor_scores(bars: DataFrame) -> DataFrame:
    """Momentum, Bollinger position, volatility contraction and volume spike; a factor without enough bars is 0."""
    r = {k: change(C("close"), k) for k in (21, 63, 126)}
    d = bars.select(
        "symbol", "date", "close",
        (0.2 * r[21] + 0.4 * r[63] + 0.4 * r[126]).alias("_m"),
        rolling(F.avg, C("close"), 20).alias("_mid"), rolling(F.stddev_samp, C("close"), 20).alias("_std"),
        change(C("close"), 1).alias("_r"), change(C("close"), 5).alias("_r5"),
        (C("volume") / rolling(F.avg, C("volume"), 20)).alias("_v"),
    )
    d = d.withColumn("_s20", rolling(F.stddev_samp, C("_r"), 20)).withColumn("_s60", rolling(F.stddev_samp, C("_r"), 60))
    pct_b = (C("close") - (C("_mid") - 2 * C("_std"))) / (4 * C("_std"))
    spike = F.when(C("_v") > 1.5, F.least(C("_v") / 3, F.lit(1.0))).when(C("_v") >= 1.2, 0.3).otherwise(0.0)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return d.select(
        "symbol", "date", "close",
        zero(clip(C("_m") / 0.5, -1, 1)).alias("momentum"),
        zero(F.when(C("_std") > 0, clip((0.5 - pct_b) * 2, -1, 1))).alias("bollinger"),
        zero(F.when(C("_s60") > 0, clip((1 - C("_s20") / C("_s60")) / 0.4, -1, 1))).alias("volatility"),
        zero(spike * F.signum(C("_r5"))).alias("volume"),
    )


def composite(scores: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    total = sum((C(k) * w for k, w in weights.items()), F.lit(0.0)) * 100
    label = F.when(C("composite") >= LONG, "LONG").when(C("composite") <= SHORT, "SHORT").otherwise("HOLD")
    return scores.withColumn("composite", total).withColumn("label", label)


def rank_latest(bars: DataFrame) -> DataFrame:
    """Each symbol's latest bar, by composite score; ties by symbol."""
    last = Window.partitionBy("symbol").orderBy(F.desc("date"))
    d = composite(factor_scores(bars)).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("composite", 6)), "symbol")).cast("long"))


def markov_score(closes: DataFrame, window: int = 60, band: float = 0.005) -> DataFrame:
    """P(rise) - P(fall) after the last state of the ``window`` bars that end the bar before; 0 while warming up. One series (date, close) per symbol."""
    r = change(C("close"), 1)
    d = closes.withColumn("_r", r).withColumn("s", F.when(C("_r") > band, 1).when(C("_r") < -band, -1).when(C("_r").isNotNull(), 0)).withColumn("p", F.lag("s").over(by_symbol()))
    frame = by_symbol().rowsBetween(-(window - 1), -1)
    d = d.withColumn("last", F.lag("s").over(by_symbol()))
    for a in (-1, 0, 1):
        hit = (C("p") == a).cast("long")
        d = d.withColumn(f"n{a}", F.sum(hit).over(frame)).withColumn(f"u{a}", F.sum(hit * C("s")).over(frame))
    score = F.lit(None).cast("double")
    for a in (-1, 0, 1):
        score = F.when((C("last") == a) & (C(f"n{a}") > 0), C(f"u{a}") / C(f"n{a}")).otherwise(score)
    warm = F.count("s").over(by_symbol().rowsBetween(-window, -1)) >= window
    return d.select("symbol", "date", F.when(warm, F.coalesce(score, F.lit(0.0))).otherwise(0.0).alias("markov"))


def markov_matrix(closes: DataFrame, band: float = 0.005) -> DataFrame:
    """Transition counts and probabilities over the whole history of each symbol."""
    r = change(C("close"), 1)
    d = closes.withColumn("_r", r).withColumn("state", F.when(C("_r") > band, "BULL").when(C("_r") < -band, "BEAR").when(C("_r").isNotNull(), "SIDE"))
    d = d.withColumn("prev", F.lag("state").over(by_symbol())).where("prev is not null")
    n = d.groupBy("symbol", "prev", "state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", C("n") / F.sum("n").over(Window.partitionBy("symbol", "prev")))


def regime_scores(regime: DataFrame) -> DataFrame:
    """Volatility score 1 - 2 pct and flow score 2 pct - 1 of the ten-day flow, by rolling percentile. One market-wide series."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = regime.withColumn("flow10", rolling(F.sum, C("flow"), 10, window=w))
    return d.select("date", "vix", (1 - 2 * percentile_of_last("vix", 252, 30, w)).alias("vix_score"), "flow10", (2 * percentile_of_last("flow10", 252, 30, w) - 1).alias("flow_score"))


def valuation(fundamentals: DataFrame) -> DataFrame:
    """Means of the clipped ratios that are there, and the mean of both."""
    value = F.array_compact(F.array(clip((20 - C("pe_ratio")) / 20, -1, 1), clip((3 - C("pb_ratio")) / 3, -1, 1)))
    health = F.array_compact(F.array(clip((1 - C("debt_to_equity")) / 1, -1, 1), clip(C("current_ratio") - 1, -1, 1)))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    return fundamentals.select("symbol", "industry", mean(value).alias("valuation"), mean(health).alias("health"))


def index_trend(closes: DataFrame) -> DataFrame:
    """Half by the distance to the 50-bar mean (30 bars at least), half by that to the 200-bar mean (100 at least), each times 10 and clipped."""
    a, b = rolling(F.avg, C("close"), 50, 30), rolling(F.avg, C("close"), 200, 100)
    part = lambda m: F.coalesce(clip((C("close") - m) / m * 10, -1, 1), F.lit(0.0)) * 0.5
    return closes.select("symbol", "date", "close", (part(a) + part(b)).alias("trend"))


def sector_rotation(sectors: DataFrame, bench: DataFrame, n: int = 20) -> DataFrame:
    """A sector's n-bar return less the benchmark's on the same dates, over 0.2 and clipped."""
    s = sectors.withColumn("symbol", C("index_name")).select("symbol", "date", change(C("close"), n).alias("rs"))
    m = bench.withColumn("symbol", F.lit(0)).select("date", change(C("close"), n).alias("rb"))
    return s.join(m, "date").select("symbol", "date", F.coalesce(clip((C("rs") - C("rb")) / 0.2, -1, 1), F.lit(0.0)).alias("rotation"))
