"""Drift after earnings: from a filing's first broadcast to the bar that can react to it, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import by_symbol

C = F.col
CLOSE = "15:30:00"  # fixed value: a broadcast up to then can move the same day's bar
HORIZONS = (5, 20, 60)


def first_broadcasts(filings: DataFrame) -> DataFrame:
    """(symbol, period, ts): the earliest broadcast; filings without a period or a time take no part."""
    return filings.where("period is not null and ts is not null").groupBy("symbol", "period").agg(F.min("ts").alias("ts"))


def reaction_bars(events: DataFrame, bars: DataFrame, bar: Column, most_days: int = 5) -> DataFrame:
    """Each event (symbol, ts) with ``bar``, an expression over its symbol's bars, of the first bar that can react: the event's own day if it
    came before the close, else the first later one. Events whose bar is more than ``most_days`` days off, or isn't there, go."""
    day = C("ts").cast("date")
    late = F.date_format("ts", "HH:mm:ss") > CLOSE
    rows = events.withColumns({"_day": day, "_at": F.when(late, F.date_add(day, 1)).otherwise(day), "_side": F.lit(1)})
    known = bars.select("symbol", C("date").alias("_at"), F.struct(C("date"), bar.alias("of")).alias("_bar"), F.lit(0).alias("_side"))
    ahead = Window.partitionBy("symbol").orderBy(F.desc("_at"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.unionByName(known, allowMissingColumns=True).withColumn("bar", F.last("_bar", ignorenulls=True).over(ahead)).where("_side = 1")
    return d.where(F.datediff(C("bar.date"), C("_day")) <= most_days).select(*events.columns, C("bar.date").alias("date"), C("bar.of").alias("bar"))


def earnings_drift(filings: DataFrame, bars: DataFrame, bench: DataFrame, members: DataFrame | None = None, index_name: str = "", least_bars: int = 80) -> DataFrame:
    """(symbol, period, date, quarter, reaction, ar5, ar20, ar60, tercile) of every first broadcast with whole paths in symbol and benchmark.

    The reaction is the bar's return less the benchmark's, drift the returns from there on less the benchmark's. Terciles cut a quarter's
    reactions by rank into equal parts; equal reactions go by date and symbol. ``members``: spells; events outside them go.
    """
    w = by_symbol()
    path = F.struct((C("close") / F.lag("close").over(w) - 1).alias("r"), *((F.lead("close", h).over(w) / C("close") - 1).alias(f"f{h}") for h in HORIZONS), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"))
    d = reaction_bars(first_broadcasts(filings), bars, path)
    days = Window.partitionBy(F.lit(0)).orderBy("date")  # one series: a row a date
    market = bench.select("date", (C("close") / F.lag("close").over(days) - 1).alias("m"), *((F.lead("close", h).over(days) / C("close") - 1).alias(f"m{h}") for h in HORIZONS))
    d = d.where(C("bar.n") >= least_bars).join(market, "date")
    if members is not None:
        from marlstone.operators.align import pit_filter

        d = pit_filter(d, members, index_name)
    d = d.select("symbol", "period", "date", F.concat(F.year("date"), F.lit("Q"), F.quarter("date")).alias("quarter"), (C("bar.r") - C("m")).alias("reaction"), *((C(f"bar.f{h}") - C(f"m{h}")).alias(f"ar{h}") for h in HORIZONS)).dropna()
    place = F.row_number().over(Window.partitionBy("quarter").orderBy("reaction", "date", "symbol", "period")) - 1
    last = F.count(F.lit(1)).over(Window.partitionBy("quarter")) - 1
    d = d.withColumns({"_r": place, "_n": last})
    return d.withColumn("tercile", F.when(3 * C("_r") <= C("_n"), "T1_neg").when(3 * C("_r") <= 2 * C("_n"), "T2_mid").otherwise("T3_pos")).drop("_r", "_n")


def drift_table(drift: DataFrame, least: int = 50) -> DataFrame:
    """By tercile and horizon: events, mean and median in basis points, share above 0, and t by months (the mean of monthly means over its error).

    Terciles with fewer than ``least`` events are marked insufficient and have no figures.
    """
    long = drift.select("tercile", "date", "reaction", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), C(f"ar{h}").alias("ar")) for h in HORIZONS))).alias("x")).select("tercile", "date", "reaction", "x.*")
    whole = long.groupBy("tercile", "horizon").agg(F.count(F.lit(1)).alias("n"), (F.avg("reaction") * 1e4).alias("reaction_bp"), (F.avg("ar") * 1e4).alias("mean_bp"), (F.percentile("ar", F.lit(0.5)) * 1e4).alias("median_bp"), (F.avg((C("ar") > 0).cast("double")) * 100).alias("hit_pct"))
    months = long.groupBy("tercile", "horizon", F.trunc("date", "month").alias("m")).agg(F.avg("ar").alias("a"))
    t = months.groupBy("tercile", "horizon").agg(F.count(F.lit(1)).alias("months"), F.try_divide(F.avg("a") * F.sqrt(F.count("a")), F.stddev_samp("a")).alias("t_monthly"))
    d, enough = whole.join(t, ["tercile", "horizon"]), C("n") >= least
    return d.select("tercile", "horizon", "n", (~enough).alias("insufficient"), *(F.when(enough, C(c)).alias(c) for c in ("reaction_bp", "mean_bp", "median_bp", "hit_pct", "t_monthly", "months")))
