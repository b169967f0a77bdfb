"""Event studies, portfolio risk, ledger, options and news roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import by_symbol, change, let, rolling

C = F.col


def dominance_events(deals: DataFrame, least: float = 0.5) -> DataFrame:
    """Days on which one side's deal value outweighs the other: |(b - s) / (b + s)| above ``least``."""
    ok = deals.where(C("trade_type").isin("BUY", "SELL") & (C("quantity") > 0) & (C("price") > 0)).withColumn("value", (C("quantity") * C("price")).cast("decimal(18,2)"))
    p = ok.groupBy("symbol", "date").pivot("trade_type", ["BUY", "SELL"]).agg(F.sum("value")).fillna(0, ["BUY", "SELL"])
    d = p.withColumn("dominance", (C("BUY") - C("SELL")).cast("double") / (C("BUY") + C("SELL")).cast("double"))
    return d.where(F.abs("dominance") > least).select("symbol", "date", "dominance", F.when(C("dominance") > 0, "BUY").otherwise("SELL").alias("side"))


def event_drift(events: DataFrame, bars: DataFrame, bench: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Return from the bar after the event over h bars, less the benchmark's over the same dates. A bar on the event's day is needed."""
    b = bars.select("symbol", "date", F.lead("date").over(by_symbol()).alias("entry_date"), F.lead("close").over(by_symbol()).alias("entry"), *(x for h in horizons for x in (F.lead("close", 1 + h).over(by_symbol()).alias(f"x{h}"), F.lead("date", 1 + h).over(by_symbol()).alias(f"d{h}"))))
    d = events.join(b, ["symbol", "date"])
    m = bench.select(C("date").alias("_d"), C("close").alias("_c"))
    d = d.join(m.select(C("_d").alias("entry_date"), C("_c").alias("m0")), "entry_date")
    for h in horizons:
        d = d.join(m.select(C("_d").alias(f"d{h}"), C("_c").alias(f"m{h}")), f"d{h}", "left")
    return d.select("symbol", "date", "side", *((C(f"x{h}") / C("entry") - C(f"m{h}") / C("m0")).alias(f"car{h}") for h in horizons))


def drift_summary(drift: DataFrame, horizon: str) -> DataFrame:
    """Mean, share of rises and a t statistic over monthly means, by side."""
    d = drift.where(C(horizon).isNotNull()).groupBy("side", F.trunc("date", "month").alias("m")).agg(F.avg(horizon).alias("a"), F.count(F.lit(1)).alias("k"), F.sum((C(horizon) > 0).cast("long")).alias("up"), F.sum(horizon).alias("t"))
    return d.groupBy("side").agg(F.sum("k").alias("n"), (F.sum("t") / F.sum("k") * 10000).alias("mean_bp"), (F.sum("up") / F.sum("k")).alias("hit"), (F.avg("a") / (F.stddev_samp("a") / F.sqrt(F.count(F.lit(1))))).alias("t_stat"))


def delivery_score(delivery: DataFrame) -> DataFrame:
    """z-score of the delivered share over 60 rows (10 at least), cut at 3 and scaled to [-1, 1]; a deviation of 0 counts as 1."""
    mean, std = rolling(F.avg, C("delivery_pct"), 60, 10), rolling(F.stddev_samp, C("delivery_pct"), 60, 10)
    z = (C("delivery_pct") - mean) / F.when(std == 0, 1.0).otherwise(std)
    d = delivery.select("symbol", "date", "delivery_pct", z.alias("z"))
    return d.withColumn("score", F.when(C("z").isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), C("z"))) / 3))


def correlations(bars: DataFrame, last: int = 250) -> DataFrame:
    """Pearson correlation of each pair of symbols over their last returns, matched by place from the end."""
    d = bars.select("symbol", "date", change(C("close"), 1).alias("r")).where("r is not null")
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(C("k") <= last)
    pair = d.select(C("symbol").alias("a"), "k", C("r").alias("ra")).join(d.select(C("symbol").alias("b"), "k", C("r").alias("rb")), "k").where("a < b")
    return pair.groupBy("a", "b").agg(F.coalesce(F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")), F.lit(0.0)).alias("corr"), F.count(F.lit(1)).alias("n"))


def position_sizes(bars: DataFrame, capital: float = 1_000_000.0, cap: float = 0.05, n: int = 20) -> DataFrame:
    """Weights by inverse deviation of the latest bar, cut at ``cap``; whole shares."""
    d = bars.select("symbol", "date", "close", change(C("close"), 1).alias("r")).withColumn("sd", rolling(F.stddev_samp, C("r"), n)).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("k = 1 and sd > 0")
    d = d.withColumn("raw", (1 / C("sd")) / F.sum(1 / C("sd")).over(Window.partitionBy())).withColumn("weight", F.least("raw", F.lit(cap)))
    return d.select("symbol", "close", "weight", F.floor(C("weight") * capital / C("close")).alias("shares"))


def iv_skew(chain: DataFrame, within: float = 0.15) -> DataFrame:
    """At-the-money volatility (mean of the options nearest to deltas of 0.5 and -0.5) and the 25-delta skew, by name and expiry."""

    def near(target: float):
        gap = F.abs(C("delta") - target)
        return F.min_by("iv", F.when(gap <= within, F.struct(gap, "option_id")))

    d = chain.groupBy("name", "expiry_id").agg(near(0.5).alias("c50"), near(-0.5).alias("p50"), near(0.25).alias("c25"), near(-0.25).alias("p25"), F.count(F.lit(1)).alias("strikes"))
    return d.select("name", "expiry_id", "strikes", F.when(C("c50").isNotNull() & C("p50").isNotNull(), (C("c50") + C("p50")) / 2).alias("atm_iv"), (C("p25") - C("c25")).alias("rr25_skew"))


# A small polarity lexicon.
LEXICON = {"the": 1, "of": -1, "and": 1, "der": -1, "und": 1, "de": -1, "la": 1, "le": 1, "les": -1, "en": 1, "is": 1, "was": -1}


def polarity(text: Column) -> Column:
    """Mean weight of the words of the lexicon in a text; null without any."""
    weights = F.create_map(*(x for k, v in LEXICON.items() for x in (F.lit(k), F.lit(v))))
    hits = F.array_compact(F.transform(F.split(F.lower(text), r"\s+"), lambda t: F.try_element_at(weights, t)))
    return let(hits, lambda h: F.when(F.size(h) > 0, F.aggregate(h, F.lit(0).cast("double"), lambda s, x: s + x) / F.size(h)))


def news_sentiment(news: DataFrame) -> DataFrame:
    """By symbol and date: articles without repeats of a headline, mean polarity of those that have any, and their sources. Of repeats the smallest id counts.

    Scored before the shuffle, which carries a digest instead of the text.
    """
    d = news.withColumn("score", polarity(C("headline")))
    first = d.groupBy("symbol", F.sha2("headline", 256).alias("_text")).agg(F.min(F.struct("doc_id", "date", "source", "score")).alias("_a"))
    d = first.select("symbol", "_a.*")
    return d.groupBy("symbol", "date").agg(F.avg("score").alias("sent_score"), F.count("score").alias("n_articles"), F.array_join(F.array_sort(F.collect_set(F.when(C("score").isNotNull(), C("source")))), ",").alias("sources"))


# Kinds of counterparties by words of their names, first match wins.
KINDS = (("FUND", "fund"), ("BANK", "bank"), ("#00000000", "house"), ("SUPPLIER", "trader"))


def counterparties(deals: DataFrame) -> DataFrame:
    """Deals and value by kind of counterparty and side."""
    name = F.upper(F.concat(F.lit(" "), "client_name", F.lit(" ")))
    kind = F.lit("other")
    for word, label in reversed(KINDS):
        kind = F.when(F.contains(name, F.lit(word)), label).otherwise(kind)
    return deals.where(C("trade_type").isin("BUY", "SELL")).groupBy(kind.alias("kind"), "trade_type").agg(F.count(F.lit(1)).alias("deals"), F.sum((C("quantity") * C("price")).cast("decimal(18,2)")).cast("double").alias("value"))


def variance_premium(regime: DataFrame, bench: DataFrame, n: int = 21) -> DataFrame:
    """Volatility index less the volatility realised over the next n bars, by date."""
    b = bench.withColumn("symbol", F.lit(0)).withColumn("_l", F.ln(C("close") / F.lag("close").over(by_symbol())))
    frame = by_symbol().rowsBetween(1, n)
    rv = F.when(F.count("_l").over(frame) == n, F.stddev_samp("_l").over(frame) * F.sqrt(F.lit(252.0)) * 100)
    return b.select("date", rv.alias("realised")).where("realised is not null").join(regime.select("date", "vix"), "date").select("date", "vix", "realised", (C("vix") - C("realised")).alias("premium"))


def risk_report(bars: DataFrame, bench: DataFrame, share: float = 0.05) -> DataFrame:
    """By symbol: yearly volatility (population), beta on matching dates (30 at least), value at risk by the floor index of the sorted returns."""
    d = bars.select("symbol", "date", change(C("close"), 1).alias("r")).where("r is not null")
    m = bench.withColumn("symbol", F.lit(0)).select("date", change(C("close"), 1).alias("m")).where("m is not null")
    beta = d.join(m, "date").groupBy("symbol").agg(F.when(F.count(F.lit(1)) >= 30, F.covar_pop("r", "m") / F.var_pop("m")).alias("beta"))
    ranked = d.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("r")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    v = ranked.groupBy("symbol").agg((F.stddev_pop("r") * F.sqrt(F.lit(252.0))).alias("volatility"), F.max(F.when(C("k") == F.floor(C("n") * share), -C("r"))).alias("var"), F.count(F.lit(1)).alias("n"))
    return v.join(beta, "symbol", "left").select("symbol", "n", "volatility", "beta", "var")


def concentration(ledger: DataFrame, most: float = 0.25) -> DataFrame:
    """Share of each sleeve in the value bought, and whether it is above ``most``."""
    v = ledger.where("side = 'BUY'").groupBy("sleeve").agg(F.sum((C("qty") * C("price")).cast("decimal(18,2)")).alias("v"))
    s = C("v").cast("double") / F.sum("v").over(Window.partitionBy()).cast("double")
    return v.select("sleeve", C("v").cast("double").alias("value"), s.alias("share"), (s > most).alias("over"))


def condor_legs(chain: DataFrame) -> DataFrame:
    """By name and expiry the options nearest to deltas of 0.25, 0.1, -0.25 and -0.1, where all four are there and in order."""

    def near(t: float, kind: str):
        return F.min_by("strike", F.when(C("option_type") == kind, F.struct(F.abs(C("delta") - t), "option_id")))

    d = chain.groupBy("name", "expiry_id").agg(near(0.25, "CE").alias("sell_call"), near(0.1, "CE").alias("buy_call"), near(-0.25, "PE").alias("sell_put"), near(-0.1, "PE").alias("buy_put"))
    return d.where("buy_call > sell_call and sell_put > buy_put").withColumn("width", F.greatest(C("buy_call") - C("sell_call"), C("sell_put") - C("buy_put")))
