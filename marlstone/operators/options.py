"""Option prices, four-leg positions by delta and their settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.expr import norm_cdf
from marlstone.operators.align import asof

C = F.col
# The yearly rate of interest, contracts a lot and the deltas of the legs.
RATE, LOT = 0.065, 75
LEGS = {"short_call": ("CE", 0.25), "short_put": ("PE", -0.25), "long_call": ("CE", 0.10), "long_put": ("PE", -0.10)}


def option_price(kind: str, spot: Column, strike: Column, iv: Column, days: Column, rate: float = RATE) -> Column:
    """Black-Scholes price of a call (``CE``) or put (``PE``); iv in percent, half a day at least."""
    t = F.greatest(days.cast("double"), F.lit(0.5)) / 365
    sigma = iv / 100
    d1 = (F.ln(spot / strike) + (rate + sigma * sigma / 2) * t) / (sigma * F.sqrt(t))
    d2 = d1 - sigma * F.sqrt(t)
    paid = strike * F.exp(-rate * t)
    return spot * norm_cdf(d1) - paid * norm_cdf(d2) if kind == "CE" else paid * norm_cdf(-d2) - spot * norm_cdf(-d1)


def open_condors(chain: DataFrame, opened: str, spots: DataFrame, lot: int = LOT) -> DataFrame:
    """By (name, expiry) of a chain (name, expiry, option_id, option_type, strike, iv, delta): strikes of the legs nearest to their deltas (ties: smaller
    option_id), their prices, credit and greatest loss, and a status.

    ``spots``: (name, date, close); the last at or before ``opened`` is the spot. Status is open, thin (a leg is missing), degenerate (wings not beyond the
    shorts) or no_spot. Options without a delta or with an iv of 0 or less don't count.
    """
    good = C("delta").isNotNull() & ~F.isnan("delta") & (C("iv") > 0)
    leg = lambda kind, t: F.min_by(F.struct(C("strike").cast("double").alias("strike"), "iv"), F.when(good & (C("option_type") == kind), F.struct(F.abs(C("delta") - t), "option_id")))
    d = chain.groupBy("name", "expiry").agg(*(leg(*x).alias(k) for k, x in LEGS.items()))
    d = d.withColumn("date", F.lit(opened).cast("date"))
    d = asof(d, spots.select("name", "date", "close"), "close", ["name"], out="spot").withColumn("days", F.greatest(F.datediff("expiry", "date"), F.lit(1)))
    strike = {k: C(f"{k}.strike") for k in LEGS}
    price = {k: option_price(kind, C("spot"), strike[k], C(f"{k}.iv"), C("days")) for k, (kind, _) in LEGS.items()}
    credit = price["short_call"] + price["short_put"] - price["long_call"] - price["long_put"]
    width = F.greatest(strike["long_call"] - strike["short_call"], strike["short_put"] - strike["long_put"])
    thin = C("short_call").isNull() | C("short_put").isNull()
    crossed = (strike["long_call"] <= strike["short_call"]) | (strike["long_put"] >= strike["short_put"])
    status = F.when(thin, "thin").when(crossed, "degenerate").when(C("spot").isNull() | (C("spot") <= 0), "no_spot").otherwise("open")
    d = d.withColumn("status", status)
    ok = C("status") == "open"
    only = lambda x, name: F.when(ok, x).alias(name)
    return d.select(
        "name", "expiry", C("date").alias("opened"), "days", "spot", "status", *(only(strike[k], f"{k}_strike") for k in LEGS), *(only(F.round(price[k], 2), f"{k}_price") for k in LEGS),
        only(F.round(credit, 2), "credit"), only(F.round(credit * lot, 0), "credit_value"), only(F.round((width - credit) * lot, 0), "max_loss"),
    )


def settled_condors(condors: DataFrame, spots: DataFrame, today: str, lot: int = LOT) -> DataFrame:
    """Open positions due by ``today`` with the first close on or after their expiry, payoff in points and money; those without such a close by then, or
    that aren't due, stay open. Positions of another status are left out."""
    due = condors.where("status = 'open'")
    day = F.lit(today).cast("date")
    # the first close on or after a day is the last one at or before it when time runs backwards
    back = lambda c: F.datediff(F.lit("1970-01-01").cast("date"), c)
    closes = spots.where(C("date") <= day).select("name", back(C("date")).alias("_t"), F.struct("date", "close").alias("bar"))
    d = asof(due.withColumn("_t", back(C("expiry"))).withColumnRenamed("_t", "_at"), closes.withColumnRenamed("_t", "_at"), "bar", ["name"], on="_at")
    is_due = (C("expiry") <= day) & C("bar").isNotNull()
    s = C("bar.close")
    inner = lambda x: F.greatest(x, F.lit(0.0))
    points = C("credit") - inner(s - C("short_call_strike")) - inner(C("short_put_strike") - s) + inner(s - C("long_call_strike")) + inner(C("long_put_strike") - s)
    return d.select(
        "name", "expiry", "opened", "credit", F.when(is_due, "settled").otherwise("open").alias("status"), F.when(is_due, C("bar.date")).alias("settle_date"), F.when(is_due, s).alias("settle_spot"),
        F.when(is_due, F.round(points, 2)).alias("points"), F.when(is_due, F.round(points * lot, 0)).alias("profit"),
    )


def condor_book(settled: DataFrame) -> DataFrame:
    """By name and in total: positions, settled ones, winners and profit."""
    done = C("status") == "settled"
    g = settled.rollup("name").agg(F.count(F.lit(1)).alias("positions"), F.count(F.when(done, 1)).alias("settled"), F.count(F.when(C("profit") > 0, 1)).alias("winners"), F.coalesce(F.sum("profit"), F.lit(0.0)).alias("profit"))
    return g.withColumn("name", F.coalesce("name", F.lit("TOTAL")))
