"""Further indicators, factor scores, cross-sectional measures, risk figures and event screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import norm_cdf

C = F.col


def _w(*order: Column | str, by: str = "symbol") -> Window:
    return Window.partitionBy(by).orderBy(*(order or ("date",)))


def _full(f, x: str | Column, n: int, least: int | None = None) -> Column:
    """An aggregate over the last ``n`` rows, null where fewer than ``least`` of them have a value."""
    frame = _w().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) >= (least or n), f(x).over(frame))


def _clip(x: Column, a: float, b: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(a), F.least(F.lit(b), x)))


def _ret(x: str = "close", n: int = 1) -> Column:
    return C(x) / F.lag(x, n).over(_w()) - 1


def rolling_median(bars: DataFrame, n: int = 10) -> DataFrame:
    return bars.select("symbol", "date", _full(lambda x: F.percentile(x, F.lit(0.5)), "close", n).alias("median"))


def rsi_simple(bars: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength from plain rolling means; a loss of zero counts as a ratio of 100."""
    d = bars.select("symbol", "date", "close").withColumn("d", C("close") - F.lag("close").over(_w()))
    d = d.withColumn("gain", F.greatest(C("d"), F.lit(0.0))).withColumn("loss", F.greatest(-C("d"), F.lit(0.0)))
    d = d.withColumn("gain", F.when(C("d").isNotNull(), C("gain"))).withColumn("loss", F.when(C("d").isNotNull(), C("loss")))
    d = d.withColumn("g", _full(F.avg, "gain", n)).withColumn("l", _full(F.avg, "loss", n))
    return d.select("symbol", "date", (100 - 100 / (1 + F.when(C("l") == 0, F.lit(100.0)).otherwise(C("g") / C("l")))).alias("rsi"))


def bar_context(bars: DataFrame) -> DataFrame:
    """Ordinal of the bar, days since the one before, and the highest high of the last 22 bars."""
    return bars.select("symbol", "date", F.row_number().over(_w()).alias("bar"), F.datediff("date", F.lag("date").over(_w())).alias("gap"), F.max("high").over(_w().rowsBetween(-21, 0)).alias("highest"))


def sma_crosses(bars: DataFrame) -> DataFrame:
    """Bars on which the 20-bar mean crosses the 50-bar mean."""
    d = bars.select("symbol", "date", _full(F.avg, "close", 20).alias("a"), _full(F.avg, "close", 50).alias("b"))
    d = d.withColumn("pa", F.lag("a").over(_w())).withColumn("pb", F.lag("b").over(_w()))
    kind = F.when((C("pa") <= C("pb")) & (C("a") > C("b")), "golden").when((C("pa") >= C("pb")) & (C("a") < C("b")), "death")
    return d.withColumn("cross", kind).where("cross is not null").select("symbol", "date", "cross")


def trend_factors(bars: DataFrame) -> DataFrame:
    """Trend, mean-reversion and the simplified composite. A mean that isn't there yet compares as false."""
    z = lambda n: F.try_divide(C("close") - _full(F.avg, "close", n), _full(F.stddev_samp, "close", n))
    d = bars.select("symbol", "date", "close", _full(F.avg, "close", 20).alias("s20"), _full(F.avg, "close", 50).alias("s50"), z(20).alias("z20"), z(50).alias("z50"), _ret(n=63).alias("r63"))
    side = lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(-v))
    trend = side(C("close") > C("s20"), 0.25) + side(C("close") > C("s50"), 0.25) + side(C("s20") > C("s50"), 0.5)
    mixed = 0.6 * _clip(C("r63") / 0.3, -1.0, 1.0) + 0.4 * _clip(-C("z20") / 2, -1.0, 1.0)
    return d.select("symbol", "date", trend.alias("trend"), _clip(-C("z50") / 2, -1.0, 1.0).alias("reversion"), mixed.alias("simple_composite"))


def put_call_ratio(chain: DataFrame) -> DataFrame:
    """Open interest of puts over that of calls; null without calls."""
    of = lambda kind: F.sum(F.when(C("option_type") == kind, C("oi")).otherwise(0))
    g = chain.groupBy("name").agg(of("PE").alias("put_oi"), of("CE").alias("call_oi"))
    return g.select("name", "put_oi", "call_oi", F.try_divide(C("put_oi").cast("double"), C("call_oi").cast("double")).alias("pcr"))


def every_kth(bars: DataFrame, k: int = 21) -> DataFrame:
    """Non-overlapping samples: the first bar and every k-th after it."""
    return bars.withColumn("o", F.row_number().over(_w()) - 1).where(C("o") % k == 0).select("symbol", "date", "close")


def cohorts(bars: DataFrame, start: int = 30, k: int = 5) -> DataFrame:
    return bars.withColumn("o", F.row_number().over(_w()) - 1).where((C("o") >= start) & ((C("o") - start) % k == 0)).select("symbol", "date", C("o").cast("long").alias("bar"))


def day_buckets(ticks: DataFrame) -> DataFrame:
    """Ticks by UTC day and the weekday that follows it."""
    day = F.to_date("ts")
    nxt = F.when(F.weekday("day") == 4, F.date_add("day", 3)).when(F.weekday("day") == 5, F.date_add("day", 2)).otherwise(F.date_add("day", 1))
    return ticks.groupBy("symbol", day.alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("next_day", nxt)


def deal_profile(deals: DataFrame) -> DataFrame:
    """By symbol and day: value-weighted price, and the share of the largest deal."""
    g = deals.groupBy("symbol", "date").agg((F.sum(C("price") * C("quantity")) / F.sum("quantity")).alias("vwap"), (F.max("quantity") / F.sum("quantity")).alias("concentration"), F.max("price").alias("top"))
    return g.select("symbol", "date", "vwap", "concentration", (C("top") / C("vwap") - 1).alias("deviation"))


def volume_against_prior(bars: DataFrame) -> DataFrame:
    """Volume over the mean of the 20 bars before, five at least, cut to 0 .. 10."""
    frame = _w().rowsBetween(-20, -1)
    mean = F.when(F.count("volume").over(frame) >= 5, F.avg("volume").over(frame))
    return bars.select("symbol", "date", _clip(F.try_divide(C("volume").cast("double"), mean), 0.0, 10.0).alias("spike"))


def _ranked(x: str, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0


def ic_decay(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20), least: int = 5) -> DataFrame:
    """Rank correlation by date of the three-bar reversal with returns over several horizons, summarised by horizon."""
    wide = bars.select("date", (-_ret(n=3)).alias("score"), *((F.lead("close", h).over(_w()) / C("close") - 1).alias(f"f{h}") for h in horizons))
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), C(f"f{h}").alias("fwd")) for h in horizons))
    d = wide.select("date", "score", F.explode(each).alias("f")).select("date", "score", "f.horizon", "f.fwd").where("score is not null and fwd is not null")
    d = d.select("horizon", "date", _ranked("score", "horizon", "date").alias("a"), _ranked("fwd", "horizon", "date").alias("b"))
    ic = d.groupBy("horizon", "date").agg(F.count(F.lit(1)).alias("n"), F.when((F.stddev_pop("a") > 1e-12) & (F.stddev_pop("b") > 1e-12), F.corr("a", "b")).alias("ic")).where((C("n") >= least) & C("ic").isNotNull())
    return ic.groupBy("horizon").agg(F.count(F.lit(1)).alias("dates"), F.avg("ic").alias("mean_ic"), F.avg((C("ic") > 1e-9).cast("double")).alias("positive"))


def pooled_metrics(bars: DataFrame, h: int = 20) -> DataFrame:
    """Over all rows: linear correlation of the three-bar reversal and the forward return, and the share of equal signs, zeros left out."""
    d = bars.select((-_ret(n=3)).alias("score"), (F.lead("close", h).over(_w()) / C("close") - 1).alias("fwd")).where("score is not null and fwd is not null")
    told = (C("score") != 0) & (C("fwd") != 0)
    return d.agg(F.count(F.lit(1)).alias("n"), F.corr("score", "fwd").alias("pearson"), F.avg(F.when(told, (F.signum("score") == F.signum("fwd")).cast("double"))).alias("hit_rate"))


def cs_percentile(bars: DataFrame) -> DataFrame:
    """Share of the day's symbols up to the average rank of this one's three-bar reversal."""
    d = bars.select("symbol", "date", (-_ret(n=3)).alias("rev3")).where("rev3 is not null")
    return d.select("symbol", "date", (_ranked("rev3", "date") / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("pct"))


def profit_labels(bars: DataFrame, h: int = 20) -> DataFrame:
    fwd = F.lead("close", h).over(_w()) / C("close") - 1
    return bars.select("symbol", "date", F.when(fwd.isNotNull(), (fwd > 0).cast("int")).alias("label"))


def time_groups(calendar: DataFrame, n: int = 6) -> DataFrame:
    """Contiguous groups of dates with borders at floor(i * dates / n). The calendar is small: its windows have no key."""
    w = Window.orderBy("date")
    d = calendar.select("date").distinct().withColumn("o", F.row_number().over(w) - 1).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy()))
    return d.select("date", F.floor(((C("o") + 1) * n - 1) / C("all")).cast("int").alias("group"))


def sharpe(bars: DataFrame, least: int = 20) -> DataFrame:
    d = bars.select("symbol", _ret().alias("r")).where("r is not null")
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return g.select("symbol", "n", F.when((C("n") >= least) & (C("s") > 0), C("m") / C("s") * F.sqrt(F.lit(252.0))).alias("sharpe"))


def market_fit(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Alpha and beta by symbol against the benchmark on common dates, and up and down capture."""
    m = bench.withColumn("symbol", F.lit(0)).select("date", _ret().alias("m"))
    d = bars.select("symbol", "date", _ret().alias("r")).join(m, "date").where("r is not null and m is not null")
    part = lambda c: F.avg(F.when(c, C("r"))) / F.avg(F.when(c, C("m")))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("r", "m").alias("beta"), F.regr_intercept("r", "m").alias("alpha"), part(C("m") > 0).alias("up_capture"), part(C("m") < 0).alias("down_capture"))


def year_returns(bars: DataFrame) -> DataFrame:
    d = bars.select("symbol", "date", _ret().alias("r")).where("r is not null")
    return d.groupBy("symbol", F.year("date").alias("year")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("ret"))


def corrected_psr(bars: DataFrame) -> DataFrame:
    """Probability of a positive Sharpe ratio with bias-corrected skewness and kurtosis."""
    d = bars.select("symbol", _ret().alias("r")).where("r is not null")
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).cast("double").alias("n"), (F.avg("r") / F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2")).where("n > 3")
    skew = C("g1") * F.sqrt(C("n") * (C("n") - 1)) / (C("n") - 2)
    kurt = ((C("n") + 1) * C("g2") + 6) * (C("n") - 1) / ((C("n") - 2) * (C("n") - 3)) + 3
    below = F.sqrt(F.greatest(1 - skew * C("sr") + (kurt - 1) / 4 * C("sr") * C("sr"), F.lit(1e-12)))
    return g.select("symbol", C("n").cast("long").alias("n"), skew.alias("skew"), kurt.alias("kurt"), norm_cdf(C("sr") * F.sqrt(C("n") - 1) / below).alias("psr"))


def delivery_spikes(delivery: DataFrame, bars: DataFrame) -> DataFrame:
    """Days with a delivery share more than two deviations above its 60-day mean and a move of one percent or more."""
    z = F.try_divide(C("delivery_pct") - _full(F.avg, "delivery_pct", 60, 30), _full(F.stddev_samp, "delivery_pct", 60, 30))
    d = delivery.select("symbol", "date", z.alias("z")).where("z > 2").join(bars.select("symbol", "date", _ret().alias("r")), ["symbol", "date"])
    return d.where(F.abs("r") >= 0.01).select("symbol", "date", "z", "r", F.when(C("r") > 0, "UP").otherwise("DOWN").alias("side"))


def max_orders(bars: DataFrame, value: float = 100_000.0, share: float = 0.03) -> DataFrame:
    """Shares that one order may have, by value and by part of the latest volume, and which of the two binds."""
    d = bars.withColumn("rn", F.row_number().over(_w(F.desc("date")))).where("rn = 1")
    d = d.select("symbol", F.floor(F.lit(value) / C("close")).alias("by_value"), F.floor(C("volume") * share).alias("by_volume"))
    return d.select("symbol", F.least("by_value", "by_volume").alias("shares"), F.when(C("by_value") <= C("by_volume"), "value").otherwise("volume").alias("bound"))


def price_alerts(bars: DataFrame) -> DataFrame:
    """Alerts on a symbol's mean close, above for even symbols and below for odd ones, checked against its latest close."""
    d = bars.groupBy("symbol").agg(F.avg("close").alias("threshold"), F.max_by("close", "date").alias("price"))
    d = d.withColumn("direction", F.when(C("symbol") % 2 == 0, "above").otherwise("below"))
    return d.withColumn("triggered", F.when(C("direction") == "above", C("price") >= C("threshold")).otherwise(C("price") <= C("threshold")))


def circuit_breaker(bars: DataFrame, most: float = -0.02) -> DataFrame:
    """By date, the change of a portfolio of one share of each symbol that trades on it, and whether trading stops."""
    d = bars.select("date", "close", F.lag("close").over(_w()).alias("p")).where("p is not null")
    g = d.groupBy("date").agg((F.sum("close") / F.sum("p") - 1).alias("change"))
    return g.withColumn("stop", F.round("change", 9) <= most)


def holdings(ledger: DataFrame) -> DataFrame:
    """Net quantity and value at the last traded price, by sleeve and in total."""
    signed = F.when(C("side") == "BUY", C("qty")).otherwise(-C("qty"))
    g = ledger.groupBy("sleeve", "instrument").agg(F.sum(signed).alias("qty"), F.max(F.struct("trade_date", "id", "line", "supp", "price")).alias("last"))
    return g.withColumn("value", C("qty") * C("last.price")).rollup("sleeve").agg(F.sum("qty").alias("qty"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("instruments")).withColumn("sleeve", F.coalesce("sleeve", F.lit("TOTAL")))


# What a row must reach before it may be queued.
LEAST_COMPOSITE, LEAST_CONFIDENCE, LEAST_META, LEAST_VOLUME, LEAST_POINTS = 40, 40, 0.75, 500_000, 200


def conviction(rows: DataFrame) -> DataFrame:
    """Adds passed, failed (names, in order) and gates (name, ok, value, required) to rows with composite, linear_signal, ml_path, ml_confidence,
    meta_prob, avg_volume and data_points. The model's confidence counts only where a model scored the row; what isn't known fails."""
    named = lambda name, ok, value, required: F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), value.cast("string").alias("value"), F.lit(required).alias("required"))
    least = lambda name, column, x: named(name, C(column) >= x, C(column), f">= {x}")
    gates = F.array_compact(F.array(
        least("composite", "composite", LEAST_COMPOSITE), named("linear_agreement", C("linear_signal") == "LONG", C("linear_signal"), "LONG"),
        F.when(C("ml_path"), least("ml_confidence", "ml_confidence", LEAST_CONFIDENCE)), least("meta_labeler", "meta_prob", LEAST_META),
        least("liquidity_adv", "avg_volume", LEAST_VOLUME), least("data_points", "data_points", LEAST_POINTS),
    ))
    d = rows.withColumn("gates", gates)
    failed = F.transform(F.filter("gates", lambda g: ~g["ok"]), lambda g: g["name"])
    return d.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", C("failed") == "")


def chain_status(chain: DataFrame) -> DataFrame:
    return chain.groupBy("name").agg(F.count(F.lit(1)).alias("quotes"), F.countDistinct("expiry_id").alias("expiries"), F.min("iv").alias("least_iv"), F.max("iv").alias("most_iv"))
