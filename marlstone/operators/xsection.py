"""Cross-sections: ranks, information coefficients, quantile portfolios and their costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import by_date, by_symbol, average_rank, change, rolling

C = F.col


def ic_by_date(panel: DataFrame, score: str, target: str, least: int = 5) -> DataFrame:
    """Spearman correlation of score and target by date, as the Pearson correlation of mean ranks; null where either is constant."""
    d = panel.where(C(score).isNotNull() & C(target).isNotNull())
    d = d.select("date", average_rank(C(score), ["date"]).alias("a"), average_rank(C(target), ["date"]).alias("b"))
    g = d.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("a", "b").alias("_c"), F.stddev_pop("a").alias("_a"), F.stddev_pop("b").alias("_b")).where(C("n") >= least)
    return g.select("date", "n", F.when((C("_a") > 1e-12) & (C("_b") > 1e-12), C("_c") / (C("_a") * C("_b"))).alias("ic"))


def ic_summary(ic: DataFrame, by: list[str]) -> DataFrame:
    """Mean, ratio to the population deviation, t statistic and number of dates."""
    d = ic.where("ic is not null").groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("_p"), F.stddev_samp("ic").alias("_s"), F.count(F.lit(1)).alias("dates"))
    return d.select(*by, "mean_ic", (C("mean_ic") / C("_p")).alias("icir"), (C("mean_ic") / C("_s") * F.sqrt("dates")).alias("t_stat"), "dates")


def rank_label(panel: DataFrame, target: str, least: int = 5) -> DataFrame:
    """Rank among the date's names on [-1, 1]; null for dates with too few."""
    d = panel.where(C(target).isNotNull())
    n = F.count(F.lit(1)).over(by_date())
    return d.select("date", "symbol", target, F.when(n >= least, average_rank(C(target), ["date"]) / n * 2 - 1).alias("rank_label"))


def short_horizon_signals(bars: DataFrame) -> DataFrame:
    r = {k: change(C("close"), k) for k in (1, 3, 5, 21)}
    d = bars.select("symbol", "date", "close", (-r[1]).alias("rev1"), (-r[3]).alias("rev3"), (-r[5]).alias("rev5"), r[1].alias("_r"), (F.lag("close", 5).over(by_symbol()) / F.lag("close", 26).over(by_symbol()) - 1).alias("mom21_skip5"), (F.lead("close", 1).over(by_symbol()) / C("close") - 1).alias("fwd1"))
    vol = rolling(F.stddev_samp, C("_r"), 20)
    return d.withColumn("_v", vol).select("symbol", "date", "rev1", "rev3", "rev5", F.when(C("_v") > 0, C("rev3") / C("_v")).alias("rev3_vol"), "mom21_skip5", (-C("_v")).alias("lowvol"), "fwd1")


def to_long(panel: DataFrame, signals: list[str], target: str) -> DataFrame:
    return panel.select("date", "symbol", target, F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), C(s).alias("score")) for s in signals))).alias("_x")).select("date", "symbol", target, "_x.*")


def quantile_legs(panel: DataFrame, score: str, target: str, share: float = 0.2, least: int = 5) -> DataFrame:
    """Mean target of the top and bottom floor(n * share) names (one at least) and their difference, by date; ties by symbol."""
    d = panel.where(C(score).isNotNull() & C(target).isNotNull()).withColumn("n", F.count(F.lit(1)).over(by_date())).where(C("n") >= least)
    k = F.greatest(F.floor(C("n") * share), F.lit(1))
    up = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "symbol"))
    down = F.row_number().over(Window.partitionBy("date").orderBy(score, F.desc("symbol")))
    d = d.withColumn("_u", up).withColumn("_d", down).withColumn("k", k)
    return d.groupBy("date").agg(F.first("n").alias("n"), F.avg(F.when(C("_u") <= C("k"), C(target))).alias("top"), F.avg(F.when(C("_d") <= C("k"), C(target))).alias("bottom")).withColumn("spread", C("top") - C("bottom"))


def turnover(panel: DataFrame, score: str, share: float = 0.2, least: int = 5) -> DataFrame:
    """Share of the top leg's names that weren't in it on the rebalance before; 1 on the first."""
    d = panel.where(C(score).isNotNull()).withColumn("n", F.count(F.lit(1)).over(by_date())).where(C("n") >= least)
    up = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "symbol"))
    top = d.withColumn("_u", up).where(C("_u") <= F.greatest(F.floor(C("n") * share), F.lit(1))).select("date", "symbol")
    dates = top.select("date").distinct().withColumn("o", F.row_number().over(Window.orderBy("date")))
    t = top.join(dates, "date")
    was = t.select("symbol", (C("o") + 1).alias("o"), F.lit(1).alias("was"))
    return t.join(was, ["symbol", "o"], "left").groupBy("date").agg((1 - F.sum(F.coalesce("was", F.lit(0))) / F.count(F.lit(1))).alias("turnover"))


def cost_sweep(legs: DataFrame, turn: DataFrame, basis_points: tuple[float, ...] = (0.0, 10.0, 30.0)) -> DataFrame:
    """Annualised mean and Sharpe ratio of the spread net of cost, for all costs in one pass."""
    d = legs.join(turn, "date").withColumn("cost_bp", F.explode(F.array(*map(F.lit, basis_points)))).withColumn("net", C("spread") - 2 * C("turnover") * C("cost_bp") / 10000)
    return d.groupBy("cost_bp").agg((F.avg("net") * 252).alias("annual"), (F.avg("net") / F.stddev_samp("net") * F.sqrt(F.lit(252.0))).alias("sharpe"), F.count(F.lit(1)).alias("days"))
