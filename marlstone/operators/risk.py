"""Latest prices, valued holdings, and one table of the risk alerts on a portfolio."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import by_symbol
from marlstone.operators.fund import hybrid_stops

C = F.col
MOST_FALL, MOST_SECTOR = -2.0, 25.0  # percent


def latest_prices(bars: DataFrame) -> DataFrame:
    """(symbol, last_date, price, prev_close, bars): the last close and the one before it, which is the last one where there is no other."""
    d = bars.select("symbol", "date", "close", F.lag("close").over(by_symbol()).alias("_p"))
    g = d.groupBy("symbol").agg(F.max(F.struct("date", "close", "_p")).alias("_l"), F.count(F.lit(1)).alias("bars"))
    return g.select("symbol", C("_l.date").alias("last_date"), C("_l.close").alias("price"), F.coalesce("_l._p", "_l.close").alias("prev_close"), "bars")


def priced(holdings: DataFrame, bars: DataFrame) -> DataFrame:
    """Holdings (symbol, sector, qty, avg_price) with their latest prices, value, value before and cost. Those without a price keep nulls; an unknown sector is Unknown."""
    d = holdings.join(latest_prices(bars), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    return d.withColumns({"value": C("qty") * C("price"), "value_before": C("qty") * C("prev_close"), "cost": C("qty") * C("avg_price")})


def valuation_by_sector(valued: DataFrame) -> DataFrame:
    """By sector and in total: positions, cost, value, gain in money and percent. Holdings without a price don't count."""
    g = valued.where("price is not null").rollup("sector").agg(F.count(F.lit(1)).alias("positions"), F.sum("cost").alias("cost"), F.sum("value").alias("value"))
    gain = C("value") - C("cost")
    return g.where("positions > 0").select(F.coalesce("sector", F.lit("TOTAL")).alias("sector"), "positions", "cost", "value", gain.alias("gain"), F.try_divide(100 * gain, C("cost")).alias("gain_pct"))


def risk_alerts(valued: DataFrame, bars: DataFrame, most_fall: float = MOST_FALL, most_sector: float = MOST_SECTOR) -> DataFrame:
    """(kind, severity, subject, value, bound, method) of ``priced`` holdings: closes at or below their hybrid stop, a fall of the portfolio since the closes before
    of ``most_fall`` percent or worse, and sectors above ``most_sector`` percent of its value. Holdings without a price are told as no_price_data."""
    known = valued.where("price is not null")
    row = lambda kind, severity, subject, value, bound, method=None: [F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), value.alias("value"), bound.alias("bound"), F.lit(None).cast("string").alias("method") if method is None else method.alias("method")]
    # a stop is looked up on each holding's last bar alone, so that bar stands for its entry
    entries = known.groupBy("symbol").agg(F.max("last_date").alias("entry_date"), F.max("avg_price").alias("entry_price"))
    stops = hybrid_stops(bars, entries).where("triggered").select(*row("stop_loss", "critical", C("symbol"), C("close"), C("stop"), C("method")))
    fall = known.groupBy().agg((F.sum("value") / F.sum("value_before") * 100 - 100).alias("x")).withColumn("x", F.round("x", 2))
    breaker = fall.where(C("x") <= most_fall).select(*row("circuit_breaker", "critical", F.lit("portfolio"), C("x"), F.lit(most_fall)))
    sectors = known.groupBy("sector").agg(F.sum("value").alias("_v")).withColumn("x", 100 * C("_v") / F.sum("_v").over(Window.partitionBy()))  # a row a sector
    wide = sectors.where(C("x") > most_sector).select(*row("sector_concentration", "warning", C("sector"), F.round("x", 2), F.lit(most_sector)))
    blind = valued.where("price is null").select(*row("no_price_data", "error", C("symbol"), F.lit(None).cast("double"), F.lit(None).cast("double")))
    return reduce(DataFrame.unionByName, [stops, breaker, wide, blind])


def daily_report(valued: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: the last date, value, cost, gain, number of alerts by severity, whether trading is halted, and all of it as a JSON document."""
    total = valued.where("price is not null").groupBy().agg(F.max("last_date").alias("date"), F.count(F.lit(1)).alias("positions"), F.round(F.sum("value"), 2).alias("value"), F.round(F.sum("cost"), 2).alias("cost"))
    count = lambda x: F.count(F.when(C("severity") == x, 1))
    found = alerts.groupBy().agg(count("critical").alias("critical"), count("warning").alias("warnings"), F.coalesce(F.max(C("kind") == "circuit_breaker"), F.lit(False)).alias("halted"))
    d = total.crossJoin(found).withColumn("gain", F.round(C("value") - C("cost"), 2))  # one row by one row
    return d.withColumn("document", F.to_json(F.struct("date", "positions", "critical", "warnings", "halted")))
