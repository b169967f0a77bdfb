"""Joins in time: as-of, n-th bar, intervals, and resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import by_symbol

C = F.col


def asof(left: DataFrame, right: DataFrame, value: str, by: list[str], on: str = "date", out: str | None = None) -> DataFrame:
    """The right side's last ``value`` at or before each left row, by union and a running last. Several left rows may share a time; without keys their times are told once."""
    out = out or value
    if not by:
        # without a key only a calendar of distinct times is sorted as a whole; the rows look their value up by time
        times = left.select(C(on).alias("_t")).distinct()
        marks = times.withColumn("_v", F.lit(None)).withColumn("_side", F.lit(1)).unionByName(right.select(C(on).alias("_t"), C(value).alias("_v"), F.lit(0).alias("_side")))
        w = Window.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        known = marks.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_t", out)
        return left.withColumn("_on", C(on)).join(known, F.expr("_on <=> _t"), "left").select(*left.columns, out)
    side = right.select(*by, C(on).alias("_t"), C(value).alias("_v"), F.lit(0).alias("_side"))
    rows = left.withColumn("_t", C(on)).withColumn("_side", F.lit(1)).unionByName(side, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, out)


def nth_bar_returns(signals: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Entry at the last bar at or before a signal's date; exits at the h-th bar strictly after it."""
    numbered = bars.select("symbol", "date", "close", *(F.lead("close", h).over(by_symbol()).alias(f"x{h}") for h in horizons))
    packed = numbered.withColumn("bar", F.struct("date", "close", *(f"x{h}" for h in horizons)))
    d = asof(signals, packed, "bar", ["symbol"])
    return d.select("symbol", "date", C("bar.date").alias("entry_date"), C("bar.close").alias("entry"), *((C(f"bar.x{h}") / C("bar.close") - 1).alias(f"ret{h}") for h in horizons))


def resample_week(bars: DataFrame) -> DataFrame:
    """Bars of weeks that end on Friday; the last week counts only if a bar stands on or after its Friday."""
    friday = F.date_add("date", F.pmod(F.lit(4) - F.weekday("date"), F.lit(7)).cast("int"))
    d = bars.withColumn("week_end", friday)
    last = Window.partitionBy("symbol")
    d = d.withColumn("_last", F.max("date").over(last)).where("week_end <= _last")
    return d.groupBy("symbol", "week_end").agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))


def month_ends(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("last_date"))


def candles(ticks: DataFrame, minutes: int = 15) -> DataFrame:
    """Open, high, low, close and number of ticks by window; ticks of one time go by event_id."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("n")).select("symbol", C("w.start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "n")


def members_on(membership: DataFrame, day: str) -> DataFrame:
    """Members on a date: both ends included, an open end lasts."""
    d = F.lit(day).cast("date")
    return membership.where((C("effective_from") <= d) & (F.coalesce("effective_to", F.lit("9999-12-31").cast("date")) >= d)).select("index_name", "symbol").distinct()


def pit_filter(panel: DataFrame, membership: DataFrame, index_name: str) -> DataFrame:
    """Rows of a panel whose symbol was a member of the index on the row's date. Spells of a symbol are few, so the join is on the symbol with a range behind it."""
    m = membership.where(C("index_name") == index_name).select(C("symbol").alias("_s"), "effective_from", F.coalesce("effective_to", F.lit("9999-12-31").cast("date")).alias("_to"))
    return panel.join(m, (C("symbol") == C("_s")) & C("date").between(C("effective_from"), C("_to")), "left_semi")


def interval_errors(membership: DataFrame) -> DataFrame:
    """Inverted spells, further rows of one (index, symbol, start), and spells that start at or before the end of the one before in their index.

    Inverted spells take no part in the other two checks, repeated keys none in the last; of these the open or longest row counts.
    """
    key = ["index_name", "symbol", "effective_from"]
    upside_down = F.coalesce(C("effective_to") < C("effective_from"), F.lit(False))
    to = F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))
    good = membership.where(~upside_down).withColumn("_to", to)
    good = good.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_to"))))
    first = good.where("_n = 1").withColumn("_before", F.lag("_to").over(Window.partitionBy("index_name", "symbol").orderBy("effective_from")))
    found = [membership.where(upside_down).withColumn("error", F.lit("inverted")), good.where("_n > 1").withColumn("error", F.lit("duplicate")), first.where(C("_before") >= C("effective_from")).withColumn("error", F.lit("overlap"))]
    return reduce(DataFrame.unionByName, (d.select("symbol", "index_name", "effective_from", "error") for d in found))
