"""Reads, merges and cleaning of price histories and registers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import let

C = F.col
DATE_FORMATS = ("yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy", "MMM d, yyyy")
# What every text of a format has, so that a text is held against formats that it can't have by no parser: a parser that fails is dear.
DATE_SHAPES = (r"^[+-]?\d{4,}-\d", r"^\d\d-\D", r"^\d\d/\d", r"^\D+ \d")


def _w(*order: Column | str, by: str = "symbol") -> Window:
    return Window.partitionBy(by).orderBy(*order)


def latest_bars(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of every symbol."""
    return bars.withColumn("rn", F.row_number().over(_w(F.desc("date")))).where(C("rn") <= n).select("symbol", "date", "close")


def universe(bars: DataFrame, benchmarks: list[int]) -> DataFrame:
    """All symbols but the benchmark ones."""
    return bars.select("symbol").distinct().where(~C("symbol").isin(benchmarks))


def with_fallback(*sources: DataFrame) -> DataFrame:
    """(date, close, source) of the first source that has any row, as a whole; sources are numbered from 1."""
    every = reduce(DataFrame.unionByName, (s.select("date", "close", F.lit(k).alias("source")) for k, s in enumerate(sources, 1)))
    return every.join(F.broadcast(every.agg(F.min("source").alias("source"))), "source").select("date", "close", "source")  # one row


def replace_range(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` take the place of all old rows of their symbol between their first and last date."""
    span = new.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    kept = old.join(span, "symbol", "left").where(C("a").isNull() | (C("date") < C("a")) | (C("date") > C("b")))
    return kept.select("symbol", "date", "close").unionByName(new.select("symbol", "date", "close"))


def overwrite_guard(bars: DataFrame, most: int = 100) -> DataFrame:
    """Symbols with too many rows to be overwritten."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(C("n") >= most)


def fill_where_null(target: DataFrame, source: DataFrame, column: str) -> DataFrame:
    return target.join(source.withColumnRenamed(column, "spare"), "date", "left").select("date", F.coalesce(column, "spare").alias(column))


def cross_validated_fill(first: DataFrame, second: DataFrame, overlap: int = 100, most: float = 0.02) -> DataFrame:
    """Dates that only ``second`` has are added if it agrees with ``first``: enough common dates, and a small median difference."""
    both = first.join(second.withColumnRenamed("close", "other"), "date")
    gate = both.agg(((F.count(F.lit(1)) >= overlap) & (F.percentile(F.abs(C("other") / C("close") - 1), F.lit(0.5)) <= most)).alias("ok"))
    extra = second.join(first.select("date"), "date", "left_anti").crossJoin(F.broadcast(gate)).where("ok").select("date", "close")
    return first.select("date", "close").unionByName(extra)


def missing_windows(bars: DataFrame, start: str, end: str) -> DataFrame:
    """(symbol, side, a, b): the time before the first and after the last bar that is still to be fetched."""
    g = bars.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    sides = F.array(F.struct(F.lit("older").alias("side"), F.lit(start).cast("date").alias("a"), F.date_sub("lo", 1).alias("b")), F.struct(F.lit("newer").alias("side"), F.date_add("hi", 1).alias("a"), F.lit(end).cast("date").alias("b")))
    return g.select("symbol", F.explode(sides).alias("s")).select("symbol", "s.side", "s.a", "s.b").where("a <= b")


def gap_fill_plan(bars: DataFrame, today: str, most_days: int = 30) -> DataFrame:
    """The weekdays after each symbol's last bar up to today, of at most ``most_days`` calendar days."""
    g = bars.groupBy("symbol").agg(F.max("date").alias("hi")).where(C("hi") < F.lit(today).cast("date"))
    last = F.least(F.lit(today).cast("date"), F.date_add("hi", most_days))
    return g.select("symbol", F.explode(F.sequence(F.date_add("hi", 1), last)).alias("date")).where(F.weekday("date") < 5)


def cadence_mask(bars: DataFrame) -> DataFrame:
    """Whether a symbol trades daily: the median of its last ten calendar gaps, of five at least, is 1.6 days or less."""
    gap = F.datediff("date", F.lag("date").over(_w("date")))
    d = bars.select("symbol", "date", gap.alias("gap"))
    frame = _w("date").rowsBetween(-9, 0)
    median = F.when(F.count("gap").over(frame) >= 5, F.percentile("gap", F.lit(0.5)).over(frame))
    return d.select("symbol", "date", "gap", median.alias("median_gap")).withColumn("daily", F.coalesce(C("median_gap") <= 1.6, F.lit(False)))


def history_counts(bars: DataFrame) -> DataFrame:
    """Bars by symbol, and which minimum histories they satisfy."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).select("symbol", "n", (C("n") >= 30).alias("scored"), (C("n") >= 120).alias("trained"), (C("n") >= 252).alias("tested"))


def identity_lock(rows: DataFrame, key: str, identity: str, order: list[str]) -> DataFrame:
    """Rows whose identity is the one that their key had first, or blank: a row that doesn't tell its identity stays. A key whose first
    row has none is locked to none, so that its later rows with one go."""
    first = F.first(C(identity)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    blank = F.coalesce(F.trim(C(identity)) == "", F.lit(True))
    return rows.withColumn("_first", first).where(blank | C(identity).eqNullSafe(C("_first"))).drop("_first")


def adjusted_closes(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Closes divided by the product of all later action ratios; ``actions``: (symbol, date, ratio), from which date on it holds, whether or not a bar stands there."""
    rows = bars.select("symbol", "date", "close", F.lit(None).cast("double").alias("ratio"), F.lit(1).alias("_side"))
    rows = rows.unionByName(actions.select("symbol", "date", F.lit(None).cast("double").alias("close"), C("ratio").cast("double"), F.lit(0).alias("_side")))
    # an action comes before its day's bar, so that what follows a bar are later actions only
    later = Window.partitionBy("symbol").orderBy("date", "_side").rowsBetween(1, Window.unboundedFollowing)
    factor = F.round(F.exp(F.coalesce(F.sum(F.log("ratio")).over(later), F.lit(0.0))), 9)  # a sum of logarithms ends in noise
    return rows.withColumn("factor", factor).where("_side = 1").select("symbol", "date", "factor", (C("close") / C("factor")).alias("adjusted"))


def latest_change(bars: DataFrame) -> DataFrame:
    """Latest and previous close of each symbol, and the change in percent."""
    d = bars.withColumn("previous", F.lag("close").over(_w("date"))).withColumn("rn", F.row_number().over(_w(F.desc("date"))))
    return d.where("rn = 1 and previous > 0").select("symbol", "date", "close", "previous", ((C("close") / C("previous") - 1) * 100).alias("pct"))


def sector_momentum(bars: DataFrame, nation: DataFrame) -> DataFrame:
    d = latest_change(bars).join(nation.select(C("n_nationkey").alias("symbol"), C("n_regionkey").alias("sector")), "symbol")
    return d.groupBy("sector").agg(F.avg("pct").alias("avg_pct"), F.count(F.lit(1)).alias("n"))


def movers(bars: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` largest gains and losses of the latest bars."""
    d = latest_change(bars).select("symbol", "pct")
    up = d.orderBy(F.desc("pct"), "symbol").limit(k).withColumn("side", F.lit("gainer"))
    return up.unionByName(d.orderBy("pct", "symbol").limit(k).withColumn("side", F.lit("loser")))


def close_on_or_after(days: DataFrame, series: DataFrame, most_days: int = 10) -> DataFrame:
    """(day, date, close): the first row of a series on a day or within ``most_days`` after it, by an equality join on the days between."""
    spread = days.select("day", F.explode(F.sequence("day", F.date_add("day", most_days))).alias("date"))
    return spread.join(series, "date").groupBy("day").agg(F.min(F.struct("date", "close")).alias("m")).select("day", "m.date", "m.close")


def ledger_last_dates(ledger: DataFrame, side: str = "BUY") -> DataFrame:
    last = ledger.where(C("side") == side).groupBy("instrument").agg(F.max("trade_date").alias("last_date"))
    return ledger.select("instrument").distinct().join(last, "instrument", "left")


def registry_diff(spells: DataFrame, first: str, second: str) -> DataFrame:
    """Members on only one of two dates."""

    def on(day: str) -> DataFrame:
        at = F.lit(day).cast("date")
        return spells.where((C("effective_from") <= at) & (C("effective_to").isNull() | (C("effective_to") >= at))).select("index_name", "symbol").distinct()

    a, b = on(first).withColumn("a", F.lit(True)), on(second).withColumn("b", F.lit(True))
    d = a.join(b, ["index_name", "symbol"], "full_outer").where("a is null or b is null")
    return d.select("index_name", "symbol", F.when(C("a").isNull(), "joined").otherwise("left").alias("change"))


def membership_summary(spells: DataFrame) -> DataFrame:
    return spells.groupBy("index_name").agg(F.count(F.lit(1)).alias("spells"), F.countDistinct("symbol").alias("symbols"), F.count(F.when(C("effective_to").isNull(), 1)).alias("current"), F.min("effective_from").alias("first_day"))


def parse_dates(text: Column) -> Column:
    """A date in any of ``DATE_FORMATS``; null if none fits."""
    at = lambda t, f, shape: F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(f)).cast("date"))
    return let(F.trim(text), lambda t: F.coalesce(*(at(t, f, shape) for f, shape in zip(DATE_FORMATS, DATE_SHAPES, strict=True))))


def parse_number(text: Column) -> Column:
    """A number with thousands commas; blanks and dashes are null."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    return F.when(plain.rlike(r"^-?\d+(\.\d+)?$"), plain.cast("double"))


def parse_delivery_lines(lines: DataFrame) -> DataFrame:
    """Comma-separated delivery records: type 20 of series EQ only; (name, traded, delivered, pct)."""
    p = F.transform(F.split("line", ","), lambda x: F.trim(x))
    d = lines.select(p.alias("p")).where((F.size("p") >= 7) & (C("p")[0] == "20") & (C("p")[3] == "EQ"))
    return d.select(C("p")[2].alias("name"), C("p")[4].cast("long").alias("traded"), C("p")[5].cast("long").alias("delivered"), C("p")[6].cast("double").alias("pct"))
