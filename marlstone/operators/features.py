"""The feature frame: twenty columns in a fixed order for every bar, and the data set that models learn from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.ewm import ewm_mean
from marlstone.functions.expr import by_symbol, change, clip, forward, rolling
from marlstone.operators.align import asof
from marlstone.operators.indicators import atr_wilder

C = F.col
PRICE = ["rsi", "macd", "trend_ma", "bollinger", "volume", "volatility", "relative_strength"]
MARKET = ["vix_regime", "nifty_trend", "markov_regime", "fii_fo_score"]
INTRADAY = ["overnight_gap", "intraday_range_ratio", "last_hour_momentum", "vwap_deviation", "opening_drive_vol", "closing_spike_vol", "vol_concentration"]
# The order in which models take their columns, and the weights of the linear score.
FEATURES = [*PRICE, "sector_rotation", "vix_regime", "nifty_trend", "markov_regime", "delivery_score", "fii_fo_score", *INTRADAY]
LINEAR = {"momentum": 0.15, "bollinger": 0.15, "rsi": 0.15, "macd": 0.12, "volatility": 0.20, "volume": 0.05, "relative_strength": 0.08}
OPENING, AFTERNOON, CLOSING = (555, 570), 855, 915  # candles by the minute of the day: 9:15 and 9:30, 14:15, 15:15


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def intraday_days(candles: DataFrame) -> DataFrame:
    """A row a day from candles (symbol, date, minute, open, high, low, close, volume): prices of the day, closes at two times, volumes."""
    v = C("volume").cast("double")
    at = lambda m: F.max(F.when(C("minute") == m, C("close")))
    return candles.groupBy("symbol", "date").agg(
        F.min_by("open", "minute").alias("day_open"), F.max("high").alias("day_high"), F.min("low").alias("day_low"), F.max_by("close", "minute").alias("day_close"),
        at(AFTERNOON).alias("close_14_15"), at(CLOSING).alias("close_15_15"),
        F.sum((C("high") + C("low") + C("close")) / 3 * v).alias("pv"), F.sum(v).alias("day_volume"), F.max(v).alias("largest"),
        F.sum(F.when(C("minute").isin(*OPENING), v)).alias("opening"), F.sum(F.when(C("minute") == CLOSING, v)).alias("closing"),
    )


def against_prior(x: str, n: int = 20, least: int = 5) -> Column:
    """x over the mean of the last ``n`` days before that have an x, cut to [0, 10]."""
    w = Window.partitionBy("symbol", C(x).isNull()).orderBy("date").rowsBetween(-n, -1)
    return clip(F.try_divide(C(x), F.when(F.count(x).over(w) >= least, F.avg(x).over(w))), 0, 10)


def intraday_features(candles: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, date and the seven intraday features) of the days on which all of them are known."""
    d = attach(intraday_days(candles), [atr_wilder(bars).select("symbol", "date", "atr")])
    before = F.lag("day_close").over(by_symbol())
    vwap = F.try_divide(C("pv"), C("day_volume"))
    d = d.select(
        "symbol", "date",
        F.try_divide(C("day_open") - before, before).alias("overnight_gap"), F.try_divide(C("day_high") - C("day_low"), C("atr")).alias("intraday_range_ratio"),
        F.try_divide(C("close_15_15") - C("close_14_15"), C("close_14_15")).alias("last_hour_momentum"), F.try_divide(C("day_close") - vwap, vwap).alias("vwap_deviation"),
        against_prior("opening").alias("opening_drive_vol"), against_prior("closing").alias("closing_spike_vol"), F.try_divide(C("largest"), C("day_volume")).alias("vol_concentration"),
    )
    return d.dropna(subset=INTRADAY)


def attach(rows: DataFrame, sides: list[DataFrame]) -> DataFrame:
    """Left joins of rows keyed by (symbol, date) with sides of the same key: one union, dealt by symbol, so that windows by symbol need no further
    shuffle. A side that repeats a key counts with its largest values."""
    named = [[c for c in s.columns if c not in ("symbol", "date")] for s in sides]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows.withColumn("_own", F.lit(True)), *sides]).repartition("symbol")
    same = Window.partitionBy("symbol", "date")
    return every.withColumns({c: F.max(c).over(same) for cols in named for c in cols}).where("_own").drop("_own")


def market_calendar(dates: DataFrame, series: dict[str, DataFrame]) -> DataFrame:
    """For each date the last row at or before it of every series (date, value), all series in one pass; a series' null stays a null.

    The one window without a key runs over dates only.
    """
    marks = [dates.select("date", F.lit(None).cast("string").alias("of"), F.lit(None).cast("struct<v:double>").alias("x"))]
    marks += [s.select("date", F.lit(k).alias("of"), F.struct(C("value").cast("double").alias("v")).alias("x")) for k, s in series.items()]
    by_day = reduce(DataFrame.unionByName, marks).groupBy("date").agg(*(F.max(F.when(C("of") == k, C("x"))).alias(k) for k in series))
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return by_day.select("date", *(F.last(k, ignorenulls=True).over(upto)["v"].alias(k) for k in series))


def price_scores(bars: DataFrame) -> DataFrame:
    """Adds the seven price factors and momentum to (symbol, date, close, volume, bench_close); what isn't known yet is 0."""
    w = by_symbol()
    diff = C("close") - F.lag("close").over(w)
    d = bars.withColumns({"_g": zero(F.greatest(diff, F.lit(0.0))), "_l": zero(F.greatest(-diff, F.lit(0.0)))})
    d = ewm_mean(ewm_mean(d, "_g", "_ag", 1 / 14, True, 14), "_l", "_al", 1 / 14, True, 14)
    d = ewm_mean(ewm_mean(d, "close", "_ef", 2 / 13, False), "close", "_es", 2 / 27, False)
    d = ewm_mean(d.withColumn("_m", C("_ef") - C("_es")), "_m", "_sig", 2 / 10, False).withColumn("_h", C("_m") - C("_sig"))
    r = {k: change(C("close"), k) for k in (1, 5, 21, 63, 126)}
    d = d.withColumns({
        "_r": r[1], "_r5": r[5], "_hp": F.lag("_h").over(w), "_mo": 0.2 * r[21] + 0.4 * r[63] + 0.4 * r[126], "_rs": r[63] - change(C("bench_close"), 63),
        "_a20": rolling(F.avg, C("close"), 20), "_a50": rolling(F.avg, C("close"), 50), "_d20": rolling(F.stddev_samp, C("close"), 20), "_v": F.try_divide(C("volume").cast("double"), rolling(F.avg, C("volume"), 20)),
    })
    d = d.withColumns({"_s20": rolling(F.stddev_samp, C("_r"), 20), "_s60": rolling(F.stddev_samp, C("_r"), 60)})
    side = lambda c, x: F.when(F.coalesce(c, F.lit(False)), F.lit(x)).otherwise(F.lit(-x))
    cross = F.when((C("_hp") < 0) & (C("_h") > 0), 0.3).when((C("_hp") > 0) & (C("_h") < 0), -0.3).otherwise(0.0)
    pct_b = (C("close") - (C("_a20") - 2 * C("_d20"))) / (4 * C("_d20"))
    spike = F.when(C("_v") > 1.5, F.least(C("_v") / 3, F.lit(1.0))).when(C("_v") >= 1.2, 0.3).otherwise(0.0)
    out = {
        "rsi": zero(clip(F.when(C("_al") > 0, 100 - 100 / (1 + C("_ag") / C("_al")) - 50).when(C("_ag") > 0, F.lit(50.0)) / 30, -1, 1)),
        "macd": clip(zero(clip(C("_h") / C("close") * 100, -0.7, 0.7)) + cross, -1, 1),
        "trend_ma": side(C("close") > C("_a20"), 0.25) + side(C("close") > C("_a50"), 0.25) + side(C("_a20") > C("_a50"), 0.5),
        "bollinger": zero(F.when(C("_d20") > 0, clip((0.5 - pct_b) * 2, -1, 1))),
        "volume_score": zero(spike * F.signum("_r5")),
        "volatility": zero(F.when(C("_s60") > 0, clip((1 - C("_s20") / C("_s60")) / 0.4, -1, 1))),
        "relative_strength": zero(clip(C("_rs") / 0.2, -1, 1)),
        "momentum": zero(clip(C("_mo") / 0.5, -1, 1)),
    }
    return d.select(*(c for c in bars.columns if c != "volume"), *(x.alias(k) for k, x in out.items())).withColumnRenamed("volume_score", "volume")


def scored_bars(bars: DataFrame, bench: DataFrame, market: dict[str, DataFrame], sectors: DataFrame, sector_of: DataFrame, delivery: DataFrame, intraday: DataFrame) -> DataFrame:
    """(symbol, date, close, momentum and the twenty features) of every bar.

    ``market``: series (date, value) under the names in ``MARKET``; ``sectors``: (sector, date, value); ``sector_of``: (symbol, sector); ``delivery``:
    (symbol, date, value); ``intraday``: as ``intraday_features`` returns. Market and sector values are the last at or before the bar, 0 before the first;
    delivery is the bar's own or 0; intraday features are the bar's own or null.
    """
    days = bars.select("date").distinct()
    calendar = market_calendar(days, {**market, "bench_close": bench.select("date", C("close").alias("value"))})
    packed = sectors.select("sector", "date", F.struct("value").alias("sector_value"))
    by_sector = asof(days.crossJoin(sector_of.select("sector").distinct()), packed, "sector_value", ["sector"])  # as many rows as dates and sectors
    sides = [delivery.select("symbol", "date", C("value").alias("delivery_score")), intraday.select("symbol", "date", *INTRADAY)]
    d = bars.select("symbol", "date", "close", "volume").join(sector_of, "symbol", "left").join(calendar, "date").join(by_sector, ["sector", "date"], "left")
    d = price_scores(attach(d.drop("sector"), sides))
    d = d.withColumn("sector_rotation", C("sector_value.value"))
    filled = ["sector_rotation", *MARKET, "delivery_score"]
    return d.select("symbol", "date", "close", "momentum", *(zero(C(f)).alias(f) if f in filled else C(f) for f in FEATURES))


def feature_frame(*inputs: DataFrame | dict) -> DataFrame:
    """(symbol, date and the twenty features in their order) of every bar; see ``scored_bars``."""
    return scored_bars(*inputs).select("symbol", "date", *FEATURES)


def checked_features(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """The frame itself if its features stand in the order that models expect; an error otherwise."""
    have = [c for c in df.columns if c in set(features)]
    if have != list(features):
        raise ValueError(f"features are {have}, expected {list(features)}")
    return df


def training_set(scored: DataFrame, labels: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20), required: list[str] = PRICE, least: int = 60, members: DataFrame | None = None, index_name: str = "") -> DataFrame:
    """Rows to learn from: features, linear score, forward returns by horizon, label and the row's ordinal by (date, symbol).

    A row needs the ``required`` features and the longest forward return; others may be null. Symbols with fewer than ``least`` such rows go. A label that
    isn't known counts as 0. ``members``: spells outside which rows go. Ordinals come from counts by date and ranks within the date, so no task sorts all rows.
    """
    far = f"fwd{max(horizons)}"
    d = scored.withColumns({f"fwd{h}": forward(C("close"), h) for h in horizons})
    d = d.withColumn("linear", clip(sum((C(k) * x for k, x in LINEAR.items()), F.lit(0.0)), -1, 1))
    if members is not None:
        from marlstone.operators.align import pit_filter

        d = pit_filter(d, members, index_name)
    d = d.dropna(subset=[*required, far]).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(C("_k") >= least).drop("_k")
    d = d.join(labels.select("symbol", "date", "label"), ["symbol", "date"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    ahead = d.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).select("date", (F.sum("_n").over(Window.orderBy("date")) - C("_n")).alias("_ahead"), F.sum("_n").over(Window.partitionBy()).alias("rows"), (F.row_number().over(Window.orderBy("date")) - 1).alias("day"))
    d = d.join(F.broadcast(ahead), "date")  # a row a date
    return d.withColumn("ordinal", C("_ahead") + F.row_number().over(Window.partitionBy("date").orderBy("symbol")) - 1).drop("_ahead", "momentum")
