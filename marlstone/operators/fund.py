"""A fund's ledger: positions at average cost, their values by date, limits and stops.

Buying adds to a position's total cost; selling takes the sold share of it, as long as there is something to sell. With quantities known
by sums, a trade acts on the cost as cost -> a cost + b, so runs of trades are folded apart and their few effects put together in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.cut import cut
from marlstone.functions.expr import by_symbol
from marlstone.operators.align import asof
from marlstone.operators.indicators import seeded

C = F.col
KEY = ["sleeve", "instrument"]
RUN_ROWS = 20_000  # rows that are folded together
# Limits in percent of the fund's value, and the settings of the stops.
HARD_CAP, CAP, DRAWDOWN, TOLERANCE = 25.0, 15.0, 20.0, 5.0
VOL_TIMES, VOL_ROWS, ATR_TIMES, ATR_ROWS, TRAIL_ROWS = 2.5, 20, 3.0, 14, 22


def cash_flow() -> Column:
    """What a row adds to cash: fees always take away."""
    value, fees = (C("qty") * C("price")).cast("decimal(28,8)"), F.coalesce(C("fees"), F.lit(0.0)).cast("decimal(28,8)")
    return F.when(C("side").isin("SELL", "DEPOSIT"), value - fees).otherwise(-value - fees)


def ledger_runs(ledger: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Trades with ``run``, a range of (sleeve, instrument, date, id) with about ``run_rows`` rows: a key with very many trades is in many runs."""
    trades = ledger.where(C("side").isin("BUY", "SELL"))
    order = [*KEY, "trade_date", "id", "line", "supp"]
    parts = max(1, -(-trades.count() // run_rows))
    return cut(trades.repartitionByRange(parts, *order).withColumn("run", F.spark_partition_id()))


def daily_states(ledger: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """(sleeve, instrument, trade_date, trades, qty, invested): each position as its day's last trade leaves it.

    Trades of a day go by id, line and supplier. Rows of one key, day and run are folded to one effect; a key's effects, a row a day and run, are
    applied in order.
    """
    d = ledger_runs(ledger, run_rows)
    buy = C("side") == "BUY"
    signed = F.when(buy, C("qty")).otherwise(-C("qty")).cast("decimal(28,8)")
    rows = F.array_sort(F.collect_list(F.struct("id", "line", "supp", "side", "qty", "price", "fees")))
    days = d.groupBy(*KEY, "trade_date", "run").agg(F.sum(signed).alias("moved"), F.count(F.lit(1)).alias("n"), rows.alias("rows"))
    before = Window.partitionBy(*KEY).orderBy("trade_date", "run").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("q0", F.coalesce(F.sum("moved").over(before), F.lit(0)).cast("double"))

    def step(s: Column, x: Column) -> Column:
        keep = F.when((x["side"] == "SELL") & (s["q"] > 0), 1 - x["qty"] / s["q"]).otherwise(1.0)
        paid = F.when(x["side"] == "BUY", x["qty"] * x["price"] + F.coalesce(x["fees"], F.lit(0.0))).otherwise(0.0)
        return F.struct((s["q"] + F.when(x["side"] == "BUY", x["qty"]).otherwise(-x["qty"])).alias("q"), (s["a"] * keep).alias("a"), (s["b"] * keep + paid).alias("b"))

    begin = F.struct(C("q0").alias("q"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    effects = days.select(*KEY, "trade_date", "run", "n", "moved", F.aggregate("rows", begin, step).alias("s")).select(*KEY, "trade_date", "run", C("n").cast("double").alias("n"), C("moved").cast("double").alias("moved"), "s.a", "s.b")

    def applied(rows: pd.DataFrame) -> pd.DataFrame:
        rows, cost, out = rows.sort_values(["trade_date", "run"]), 0.0, []
        for a, b in zip(rows.a, rows.b, strict=True):
            cost = a * cost + b
            out.append(cost)
        rows = rows.assign(invested=out, qty=rows.moved.cumsum().round(8), trades=rows.n.cumsum())
        return rows.drop_duplicates("trade_date", keep="last")[[*KEY, "trade_date", "trades", "qty", "invested"]]

    kinds = {f.name: f.dataType.simpleString() for f in effects.schema}
    schema = f"sleeve {kinds['sleeve']}, instrument {kinds['instrument']}, trade_date date, trades double, qty double, invested double"
    # a key's rows are its days, and one more a run that ends within a day: as many as the calendar has, not as there are trades
    return effects.groupBy(*KEY).applyInPandas(applied, schema).withColumn("trades", C("trades").cast("long"))


def positions(ledger: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Open positions: trades, quantity, total and average cost. Closed and short ones aren't open."""
    last = daily_states(ledger, run_rows).groupBy(*KEY).agg(F.max_by(F.struct("trades", "qty", "invested"), "trade_date").alias("s")).select(*KEY, "s.*")
    return last.where("qty > 1e-9").withColumn("avg_cost", C("invested") / C("qty"))


def cash(ledger: DataFrame) -> DataFrame:
    """Cash by sleeve, deposits and withdrawals included."""
    return ledger.groupBy("sleeve").agg(F.sum(cash_flow()).cast("double").alias("cash"), F.count(F.lit(1)).alias("rows"))


def nav_history(ledger: DataFrame, prices: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """(sleeve, date, invested, market_value, cash, nav) on every date of a trade in any sleeve, from the sleeve's first one on.

    A position is worth its quantity at the last close at or before the date, its cost while there is none. A position's state lasts to its next one: it is
    told once for each date of that stretch.
    """
    calendar = cut(ledger.select(C("trade_date").alias("date")).distinct().withColumn("o", F.row_number().over(Window.orderBy("date"))))
    end = calendar.agg(F.max("o")).first()[0] or 0
    states = daily_states(ledger, run_rows).join(F.broadcast(calendar.withColumnRenamed("date", "trade_date")), "trade_date")  # a row a date
    upto = F.coalesce(F.lead("o").over(Window.partitionBy(*KEY).orderBy("o")) - 1, F.lit(end))
    held = states.withColumn("_end", upto).withColumn("o", F.explode(F.sequence("o", "_end"))).where("qty > 1e-9").join(F.broadcast(calendar), "o").select(*KEY, "date", "qty", "invested")
    priced = asof(held, prices, "close", ["instrument"])
    worth = priced.groupBy("sleeve", "date").agg(F.sum("invested").alias("invested"), F.sum(F.coalesce(C("qty") * C("close"), C("invested"))).alias("market_value"))
    flows = ledger.groupBy("sleeve", C("trade_date").alias("date")).agg(F.sum(cash_flow()).alias("flow"))
    first = flows.groupBy("sleeve").agg(F.min("date").alias("first"))
    grid = calendar.select("date").crossJoin(first).where("date >= first").select("sleeve", "date")  # as many rows as sleeves and dates
    run = Window.partitionBy("sleeve").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    money = grid.join(flows, ["sleeve", "date"], "left").withColumn("cash", F.sum(F.coalesce("flow", F.lit(0))).over(run).cast("double")).drop("flow")
    zero = lambda c: F.coalesce(C(c), F.lit(0.0))
    d = money.join(worth, ["sleeve", "date"], "left").withColumns({"invested": zero("invested"), "market_value": zero("market_value")})
    return d.select("sleeve", "date", "invested", "market_value", "cash", (C("market_value") + C("cash")).alias("nav"))


def fund_flags(held: DataFrame, total_cash: DataFrame, prices: DataFrame, budgets: DataFrame, core: str) -> DataFrame:
    """(kind, sleeve, instrument, severity, pct) of every breach: a position above its cap (not in the ``core`` sleeve), one far below its cost, and a
    sleeve above its budget (sleeve, budget_pct). Percentages are of the fund's value, or of the cost for a fall."""
    last = prices.groupBy("instrument").agg(F.max_by("close", "date").alias("price"))
    marked = held.join(last, "instrument", "left").withColumn("value", F.coalesce(C("qty") * C("price"), C("invested")))
    nav = marked.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("v")).crossJoin(total_cash.agg(F.coalesce(F.sum("cash"), F.lit(0.0)).alias("c"))).select((C("v") + C("c")).alias("nav"))
    d = marked.crossJoin(F.broadcast(nav))  # one row
    pct = F.when(C("nav") > 0, 100 * C("value") / C("nav")).otherwise(0.0)
    fall = F.when(C("price").isNotNull() & (C("invested") > 0), 100 * (C("value") - C("invested")) / C("invested"))
    flag = lambda kind, severity, x: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), x.alias("pct"))
    cap = F.when((C("sleeve") != core) & (pct > HARD_CAP), flag("position_hard_cap", "critical", pct)).when((C("sleeve") != core) & (pct > CAP), flag("position_cap", "warning", pct))
    found = d.select("sleeve", "instrument", F.explode(F.array_compact(F.array(cap, F.when(fall < -DRAWDOWN, flag("position_drawdown", "warning", fall))))).alias("f")).select("f.kind", "sleeve", "instrument", "f.severity", "f.pct")
    by_sleeve = budgets.join(d.groupBy("sleeve").agg(F.sum("value").alias("value")), "sleeve", "left").crossJoin(F.broadcast(nav)).withColumn("pct", F.when(C("nav") > 0, 100 * F.coalesce(C("value"), F.lit(0.0)) / C("nav")).otherwise(0.0))
    over = by_sleeve.where((C("nav") > 0) & (C("pct") > C("budget_pct") + TOLERANCE)).select(F.lit("sleeve_budget").alias("kind"), "sleeve", F.lit(None).cast(held.schema["instrument"].dataType).alias("instrument"), F.lit("warning").alias("severity"), "pct")
    return found.unionByName(over)


def hybrid_stops(bars: DataFrame, entries: DataFrame) -> DataFrame:
    """Every bar from a holding's entry (symbol, entry_date, entry_price) on: both stops, the higher one and which it is, the distance to it, whether the
    close is at or below it; and ``ratchet``, the highest stop since the entry, with ``stopped``: whether a close has met the ratchet by then.

    The volatility stop lies ``VOL_TIMES`` deviations of log returns under the entry, the trailing one ``ATR_TIMES`` average true ranges (seeded by a plain mean)
    under the highest high. A stop without enough bars is null.
    """
    w = by_symbol()
    before = F.lag("close").over(w)
    tr = F.when(before.isNotNull(), F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before)))
    d = seeded(bars.select("symbol", "date", "high", "low", "close").withColumns({"tr": tr, "lr": F.ln(C("close") / before)}), "tr", "atr", ATR_ROWS, 1 / ATR_ROWS)
    deep = lambda fn, x, n: F.when(F.count(x).over(w.rowsBetween(1 - n, 0)) >= n, fn(x).over(w.rowsBetween(1 - n, 0)))
    d = d.withColumns({"sd": deep(F.stddev_samp, "lr", VOL_ROWS), "top": deep(F.max, "high", TRAIL_ROWS)})
    d = d.join(entries, "symbol").where("date >= entry_date")
    d = d.withColumns({"vol_stop": C("entry_price") * (1 - VOL_TIMES * C("sd")), "trail_stop": C("top") - ATR_TIMES * C("atr")})
    d = d.withColumn("stop", F.greatest("vol_stop", "trail_stop"))
    held = Window.partitionBy("symbol", "entry_date").orderBy("date")
    d = d.withColumn("ratchet", F.max("stop").over(held)).withColumn("stopped", F.max(F.coalesce(C("close") <= C("ratchet"), F.lit(False))).over(held))
    method = F.when(C("stop").isNull(), None).when(C("stop") == C("vol_stop"), "hybrid:volatility").otherwise("hybrid:chandelier")
    return d.select("symbol", "entry_date", "date", "close", "vol_stop", "trail_stop", "stop", method.alias("method"), (100 * (C("close") - C("stop")) / C("stop")).alias("distance_pct"), F.coalesce(C("close") <= C("stop"), F.lit(False)).alias("triggered"), "ratchet", "stopped")


def retire(bars: DataFrame, absent: int = 60) -> DataFrame:
    """Bars up to a symbol's first run of ``absent`` sessions without one; sessions are the dates on which any symbol trades."""
    sessions = bars.select("date").distinct().withColumn("o", F.row_number().over(Window.orderBy("date")))  # a row a date
    d = bars.join(F.broadcast(sessions), "date")
    gap = C("o") - F.lag("o").over(by_symbol()) - 1
    return d.withColumn("_gone", F.coalesce(gap >= absent, F.lit(False)).cast("int")).withColumn("_gone", F.max("_gone").over(by_symbol())).where("_gone = 0").select(*bars.columns)


def scheduled_date(anchor: Column, months: Column, day: Column) -> Column:
    """Day ``day`` of the month ``months`` after the anchor's, or that month's last."""
    first = F.add_months(F.trunc(anchor, "month"), months)
    return F.least(F.date_add(first, day - 1), F.last_day(first))


def tranche_status(plans: DataFrame, trades: DataFrame, today: str) -> DataFrame:
    """Plans (sleeve, instrument, tranches, day_of_month, started) with buys done, their mean cost, tranches expected by ``today``, overdue ones and the next due date.

    Each buy counts as one tranche. A plan that hasn't started expects nothing, and its next date is the coming ``day_of_month``; a complete one has none.
    """
    key = ["sleeve", "instrument"]
    cost = C("qty") * C("price") + F.coalesce("fees", F.lit(0.0))
    done = trades.where("side = 'BUY'").groupBy(*key).agg(F.count(F.lit(1)).alias("done"), F.sum("qty").cast("double").alias("qty"), F.sum(cost.cast("decimal(28,6)")).cast("double").alias("_cost"))
    d = plans.join(done, key, "left").fillna(0, ["done", "qty"])
    day, n, start = F.lit(today).cast("date"), C("day_of_month").cast("int"), C("started")
    # months passed since the anchor's, one less if this month's date is still ahead
    passed = (F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start)
    due = passed + F.when(scheduled_date(day, F.lit(0), n) <= day, 1).otherwise(0)
    expected = F.when(start.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(due, C("tranches").cast("int"))))
    coming = F.when(scheduled_date(day, F.lit(0), n) < day, scheduled_date(day, F.lit(1), n)).otherwise(scheduled_date(day, F.lit(0), n))
    complete = C("done") >= C("tranches")
    ahead = F.when(start.isNull(), coming).otherwise(scheduled_date(start, C("done").cast("int"), n))
    return d.select(
        *key, "tranches", C("done").cast("long").alias("done"), complete.alias("complete"), "qty", F.when(C("qty") > 0, C("_cost") / C("qty")).alias("avg_entry"), "started",
        expected.cast("long").alias("expected"), F.when(start.isNull(), 0).otherwise(F.greatest(F.lit(0), expected - C("done"))).cast("long").alias("overdue"), F.when(~complete, ahead).alias("next_due"),
    )
