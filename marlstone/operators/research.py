"""Studies on panels (timing, momentum by month, harvested variance, deflated Sharpe ratios), rebuilt memberships and file lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import average_rank, by_date, by_symbol, half_even, norm_cdf, norm_ppf
from marlstone.operators.history import parse_dates, parse_number
from marlstone.operators.studies import correlations
from marlstone.operators.xsection import to_long

C = F.col
EULER = 0.5772156649015329  # the Euler-Mascheroni constant
MEMBER_DATES = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MMM-yyyy", "dd-MM-yyyy"]  # fixed values: notations of a membership file


def _moments(x: Column) -> tuple[Column, Column]:
    """Skewness and kurtosis (3 for a normal sample) with the small-sample correction."""
    n = F.count(x).cast("double")
    return F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6) + 3


def deflated_sharpe(returns: DataFrame, by: str, value: str) -> DataFrame:
    """Probability that a trial's true Sharpe ratio exceeds the best one that as many trials without skill would show.

    Every value of ``by`` is a trial. Only the number of trials and the variance of their ratios, one row, is handed to all of them.
    """
    g = returns.where(C(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.avg(value) / F.stddev_samp(value)).alias("sr"), F.skewness(value).alias("g3"), (F.kurtosis(value) + 3).alias("g4"))
    trials = g.groupBy().agg(F.count("sr").cast("double").alias("trials"), F.var_samp("sr").alias("spread"))
    luck = (1 - EULER) * norm_ppf(1 - 1 / C("trials")) + EULER * norm_ppf(1 - 1 / (C("trials") * F.exp(F.lit(1.0))))
    d = g.crossJoin(F.broadcast(trials.select(F.when(C("trials") > 1, F.sqrt("spread") * luck).otherwise(0.0).alias("floor"))))
    z = (C("sr") - C("floor")) * F.sqrt(C("n") - 1) / F.sqrt(F.greatest(1 - C("g3") * C("sr") + (C("g4") - 1) / 4 * C("sr") * C("sr"), F.lit(1e-12)))
    return d.where("n > 1").select(by, "n", "sr", C("floor").alias("expected_max"), norm_cdf(z).alias("dsr"))


def even_legs(panel: DataFrame, score: str, target: str, share: float = 0.1) -> DataFrame:
    """Mean target of the top names by date and of top less bottom; the number of names is rounded half to even, one at least."""
    d = panel.where(C(score).isNotNull() & C(target).isNotNull()).withColumn("n", F.count(F.lit(1)).over(by_date()))
    up = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "symbol"))
    down = F.row_number().over(Window.partitionBy("date").orderBy(score, F.desc("symbol")))
    d = d.select("date", "n", C(target).alias("y"), up.alias("u"), down.alias("d"), F.greatest(half_even(C("n") * share).cast("long"), F.lit(1)).alias("k"))
    top, bottom = F.avg(F.when(C("u") <= C("k"), C("y"))), F.avg(F.when(C("d") <= C("k"), C("y")))
    return d.groupBy("date").agg(F.max("n").alias("n"), F.max("k").alias("names"), top.alias("long_only"), (top - bottom).alias("long_short"))


def monthly_momentum(bars: DataFrame, bench: DataFrame, top: int = 15, share: float = 0.1, leg: int = 5, least: int = 30, depth: int = 252, cost: float = 0.003) -> DataFrame:
    """Momentum of bars 252 to 21 back at each month's last date, held to the next month's: the ``top`` names alone, and deciles long less short.

    A name needs ``depth`` earlier bars and a bar on both dates; months with fewer than ``least`` names are left out. Turnover compares
    with the month used before. Ties go by symbol. Masks for cadence or membership are put on ``bars`` before.
    """
    w = by_symbol()
    p = bars.select("symbol", "date", "close", (F.lag("close", 21).over(w) / F.lag("close", 252).over(w) - 1).alias("mom"), F.row_number().over(w).alias("bar"))
    ends = p.groupBy(F.trunc("date", "month")).agg(F.max("date").alias("date")).select("date", F.lead("date").over(Window.orderBy("date")).alias("settle"))
    e = p.where((C("bar") > depth) & C("mom").isNotNull()).join(ends, "date").join(bars.select("symbol", C("date").alias("settle"), C("close").alias("later")), ["symbol", "settle"])
    month = Window.partitionBy("date")
    e = e.withColumn("n", F.count(F.lit(1)).over(month)).where(C("n") >= least)
    up = F.row_number().over(month.orderBy(F.desc("mom"), "symbol"))
    down = F.row_number().over(month.orderBy("mom", F.desc("symbol")))
    e = e.withColumn("up", up).withColumn("down", down).withColumn("k", F.greatest(F.floor(C("n") * share), F.lit(leg)))
    flags = e.select("symbol", "date", "settle", "n", (C("later") / C("close") - 1).alias("fwd"), (C("up") <= top).cast("int").alias("a"), (C("up") <= C("k")).cast("int").alias("l"), (C("down") <= C("k")).cast("int").alias("s"))
    order = flags.select("date").distinct().withColumn("o", F.row_number().over(Window.orderBy("date")))
    flags = flags.join(order, "date")
    was = flags.select("symbol", (C("o") + 1).alias("o"), *(C(c).alias(f"was_{c}") for c in "als"))
    mean = lambda c: F.avg(F.when(C(c) == 1, C("fwd")))
    kept = lambda c: F.coalesce(F.sum(C(c) * C(f"was_{c}")), F.lit(0))
    m = flags.join(was, ["symbol", "o"], "left").groupBy("date", "settle").agg(
        F.max("n").alias("n"), mean("a").alias("lo_gross"), (1 - kept("a") / top).alias("lo_turnover"),
        (mean("l") - mean("s")).alias("ls_gross"), (1 - (kept("l") + kept("s")) / (F.sum("l") + F.sum("s"))).alias("ls_turnover"),
    )
    b0, b1 = bench.select("date", C("close").alias("_b0")), bench.select(C("date").alias("settle"), C("close").alias("_b1"))
    m = m.join(b0, "date").join(b1, "settle").withColumn("bench", C("_b1") / C("_b0") - 1)
    m = m.withColumn("lo_net", C("lo_gross") - 2 * cost * C("lo_turnover")).withColumn("ls_net", C("ls_gross") - 4 * cost * C("ls_turnover"))
    return m.select("date", "settle", "n", "lo_gross", "lo_turnover", "lo_net", "ls_gross", "ls_turnover", "ls_net", "bench", (C("lo_net") - C("bench")).alias("excess"))


def momentum_gates(months: DataFrame) -> DataFrame:
    """Yearly figures of ``monthly_momentum`` and its three gates; below 24 months nothing is inferred and no gate is open."""
    yearly = lambda c: F.avg(c) / F.stddev_samp(c) * F.sqrt(F.lit(12.0))
    sr = F.avg("ls_net") / F.stddev_samp("ls_net")
    g3, g4 = _moments(C("ls_net"))
    z = sr * F.sqrt(F.count("ls_net") - 1) / F.sqrt(F.greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, F.lit(1e-9)))
    s = months.groupBy().agg(F.count(F.lit(1)).alias("months"), (F.avg("lo_net") * 12).alias("lo_return"), yearly("lo_net").alias("lo_sharpe"), (F.avg("excess") * 12).alias("lo_excess"), F.avg((C("excess") > 0).cast("double")).alias("hit"), yearly("ls_net").alias("ls_sharpe"), z.alias("z"))
    s = s.withColumn("psr", norm_cdf(C("z"))).drop("z")
    return s.withColumn("passed", F.coalesce((C("months") >= 24) & (C("ls_sharpe") > 0.6) & (C("psr") > 0.95) & (C("lo_excess") > 0), F.lit(False)))


def entry_timing(panel: DataFrame, threshold: float = 40.0, hold: int = 20, pct: float = 0.5, first: int = 30, stride: int = 5) -> DataFrame:
    """Pairs of entries with one exit: at the bar after an event, or at the first of three bars whose ``pct`` is high enough, else the third.

    ``panel``: (symbol, date, close, composite, pct). Events of cohort signal are bars where the composite reaches the threshold from
    below; those of cohort steady are every ``stride``-th bar from ``first`` on. Events without a bar at the exit are left out.
    """
    w = by_symbol()
    bar = F.row_number().over(w) - 1
    wait = F.when(F.lead("pct", 1).over(w) >= pct, 0).when(F.lead("pct", 2).over(w) >= pct, 1).otherwise(2)
    d = panel.select("symbol", "date", bar.alias("bar"), wait.alias("waited"), F.lead("close", hold + 1).over(w).alias("out"), *(F.lead("close", k + 1).over(w).alias(f"in{k}") for k in range(3)), ((C("composite") >= threshold) & (F.lag("composite").over(w) < threshold)).alias("crossed"))
    cohorts = F.array_compact(F.array(F.when(C("crossed"), "signal"), F.when((C("bar") >= first) & ((C("bar") - first) % stride == 0), "steady")))
    d = d.where("out is not null").select("*", F.explode(cohorts).alias("cohort"))
    timed = C("out") / F.when(C("waited") == 0, C("in0")).when(C("waited") == 1, C("in1")).otherwise(C("in2")) - 1
    return d.select("cohort", "symbol", "date", "waited", (C("out") / C("in0") - 1).alias("ret_base"), timed.alias("ret_timed")).withColumn("diff", C("ret_timed") - C("ret_base"))


def timing_summary(events: DataFrame, least: int = 30) -> DataFrame:
    """By cohort: gain of waiting, its t value over monthly means, and the worst year; null figures below ``least`` events."""
    s = events.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg((C("waited") > 0).cast("double")).alias("waited_share"), F.avg("waited").alias("waited_mean"), F.avg("diff").alias("mean_diff"), F.percentile("diff", F.lit(0.5)).alias("median_diff"), F.avg((C("diff") > 0).cast("double")).alias("hit"))
    monthly = events.groupBy("cohort", F.trunc("date", "month")).agg(F.avg("diff").alias("x")).groupBy("cohort").agg(F.count(F.lit(1)).alias("months"), (F.avg("x") / F.stddev_samp("x") * F.sqrt(F.count(F.lit(1)))).alias("t_monthly"))
    worst = events.groupBy("cohort", F.year("date").alias("y")).agg(F.avg("diff").alias("x")).groupBy("cohort").agg(F.min_by("y", F.struct("x", "y")).alias("worst_year"))
    d = s.join(monthly, "cohort").join(worst, "cohort")
    return d.select("cohort", "n", *(F.when(C("n") >= least, C(c)).alias(c) for c in ("months", "waited_share", "waited_mean", "mean_diff", "median_diff", "hit", "t_monthly", "worst_year")))


def harvest_cycles(premium: DataFrame, length: int = 21, cost: float = 0.8) -> DataFrame:
    """Short variance over cycles that don't overlap: every ``length``-th date of (date, vix, realised), with gains in volatility points."""
    d = premium.withColumn("o", F.row_number().over(Window.orderBy("date")) - 1).where(C("o") % length == 0)
    gross = (C("vix") * C("vix") - C("realised") * C("realised")) / (2 * C("vix"))
    return d.select("date", "vix", "realised", gross.alias("gross"), (gross - cost).alias("net"))


def harvest_summary(cycles: DataFrame, per_year: float = 12.0) -> DataFrame:
    """Figures of the net gains over all cycles and by tercile of the volatility index (quantiles of its values, edges to the lower one)."""
    cut = cycles.groupBy().agg(F.percentile("vix", F.lit(1 / 3)).alias("q1"), F.percentile("vix", F.lit(2 / 3)).alias("q2"))
    part = F.when(C("vix") <= C("q1") + 1e-9, "low").when(C("vix") <= C("q2") + 1e-9, "mid").otherwise("high")
    d = cycles.crossJoin(F.broadcast(cut)).select("date", "net", F.explode(F.array(F.lit("all"), part)).alias("part"))
    run = Window.partitionBy("part").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("equity", F.sum("net").over(run)).withColumn("fall", C("equity") - F.max("equity").over(run))
    return d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean"), (F.avg("net") / F.stddev_samp("net") * F.sqrt(F.lit(per_year))).alias("sharpe"), F.avg((C("net") > 0).cast("double")).alias("hit"), F.min("net").alias("worst"), F.min("fall").alias("max_fall"))


def rebuild_spells(current: DataFrame, changes: DataFrame, start: str) -> DataFrame:
    """Membership spells, both ends inclusive, from today's members and dated changes.

    ``current``: (index_name, symbol); ``changes``: (index_name, symbol, date, included, excluded) with booleans. Before a change a name
    was a member if the change excluded it (also if it included it too); after its last change the current members tell. Changes of a
    name on one date count as one.
    """
    key = ["index_name", "symbol"]
    w = Window.partitionBy(*key).orderBy("date")
    c = changes.groupBy(*key, "date").agg(F.max("excluded").alias("before"))
    edges = c.unionByName(current.select(*key).distinct().unionByName(changes.select(*key).distinct()).distinct().select(*key, F.to_date(F.lit(start)).alias("date"), F.lit(None).cast("boolean").alias("before")))
    now = current.select(*key, F.lit(True).alias("now")).distinct()
    d = edges.join(now, key, "left").withColumn("member", F.coalesce(F.lead("before").over(w), C("now"), F.lit(False)))
    d = d.withColumn("turn", (C("member") != F.coalesce(F.lag("member").over(w), F.lit(False)))).where("turn")
    return d.withColumn("effective_to", F.date_sub(F.lead("date").over(w), 1)).where("member").select(*key, C("date").alias("effective_from"), "effective_to")


def high_correlations(bars: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of symbols whose correlation is at least ``threshold`` either way."""
    risk = F.when(C("corr") > 0.8, "together").when(C("corr") < -0.8, "opposite").otherwise("moderate")
    return correlations(bars).where(F.abs("corr") >= threshold).select("a", "b", "corr", F.when(C("corr") > 0, "positive").otherwise("negative").alias("kind"), risk.alias("risk"))


def diversification(bars: DataFrame) -> DataFrame:
    """Mean absolute correlation over all pairs, and its level."""
    d = correlations(bars).groupBy().agg(F.coalesce(F.avg(F.abs("corr")), F.lit(0.0)).alias("average"), F.count(F.lit(1)).alias("pairs"))
    return d.select("average", "pairs", F.when(C("average") < 0.3, "excellent").when(C("average") < 0.5, "good").when(C("average") < 0.7, "moderate").otherwise("poor").alias("level"))


def parse_members(lines: DataFrame, default_index: str) -> DataFrame:
    """Membership lines ``symbol,index,from,to`` numbered by ``line``. A blank index is the default, a blank end is open.

    A line without a symbol or with a date in no known notation stops the job with its number.
    """
    d = lines.select("line", F.from_csv("text", "symbol string, index_name string, a string, z string", {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("p")).select("line", "p.*")
    day = lambda x: F.coalesce(*(F.try_to_timestamp(F.trim(x), F.lit(f)).cast("date") for f in MEMBER_DATES))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    bad = blank(C("symbol")) | day(C("a")).isNull() | (~blank(C("z")) & day(C("z")).isNull())
    stop = F.raise_error(F.concat(F.lit("membership line "), C("line").cast("string"), F.lit(" can't be read"))).cast("string")
    return d.select(F.when(bad, stop).otherwise(F.trim("symbol")).alias("symbol"), F.when(blank(C("index_name")), default_index).otherwise(F.trim("index_name")).alias("index_name"), day(C("a")).alias("effective_from"), F.when(~blank(C("z")), day(C("z"))).alias("effective_to"))


def parse_index_levels(lines: DataFrame) -> DataFrame:
    """Lines ``date, level`` of a volatility index: rows without a date or with no positive level go, one row a date stays (the largest line number)."""
    p = F.split("text", ",", 2)
    d = lines.select("line", parse_dates(p[0]).alias("date"), parse_number(F.get(p, F.lit(1))).alias("vix")).where("date is not null and vix > 0")
    return d.groupBy("date").agg(F.max_by("vix", "line").alias("vix"))


def parse_flow_pages(pages: DataFrame) -> DataFrame:
    """Rows (date, fii, dii) of the JSON that a page's ``__NEXT_DATA__`` script holds. Rows without a date go; a page without rows stops the job."""
    shape = "struct<props: struct<pageProps: struct<FiiDiiData: struct<fiiDiiData: array<struct<date: string, fiiNet: string, diiNet: string>>>>>>"
    blob = F.from_json(F.regexp_extract("html", r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), shape)
    rows = F.filter(blob["props"]["pageProps"]["FiiDiiData"]["fiiDiiData"], lambda x: parse_dates(x["date"]).isNotNull())
    d = pages.select(F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, rows).otherwise(F.raise_error(F.lit("a page holds no rows that can be read"))).alias("rows"))
    return d.select(F.explode("rows").alias("x")).select(parse_dates(C("x.date")).alias("date"), parse_number(C("x.fiiNet")).alias("fii"), parse_number(C("x.diiNet")).alias("dii"))


def parse_deals(lines: DataFrame) -> DataFrame:
    """Deal lines ``date,symbol,client,side,quantity,price``, quoted where numbers have commas; a byte order mark and header lines are skipped."""
    line = F.from_csv(F.regexp_replace("text", "^﻿", ""), "day string, symbol string, client string, side string, quantity string, price string")
    deal = lambda p: F.struct(parse_dates(p["day"]).alias("date"), F.trim(p["symbol"]).alias("symbol"), F.trim(p["client"]).alias("client"), F.upper(F.trim(p["side"])).alias("side"), parse_number(p["quantity"]).alias("quantity"), parse_number(p["price"]).alias("price"))
    # a filter above would be pushed down, and each line be made and parsed once more for it
    return lines.select(F.inline(F.filter(F.transform(F.array(line), deal), lambda r: r["date"].isNotNull() & r["quantity"].isNotNull())))


def factor_ics(panel: DataFrame, factors: list[str], target: str, last: int = 252, least: int = 5) -> DataFrame:
    """Mean Spearman correlation with the target by factor over each symbol's ``last`` rows, and the number of dates, in one pass over the panel."""
    recent = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    d = panel.select("symbol", "date", target, *factors).withColumn("_k", recent).where(C("_k") <= last)
    d = to_long(d, factors, target).where(C("score").isNotNull() & C(target).isNotNull())
    d = d.select("signal", "date", average_rank(C("score"), ["signal", "date"]).alias("a"), average_rank(C(target), ["signal", "date"]).alias("b"))
    g = d.groupBy("signal", "date").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("a", "b").alias("c"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb")).where((C("n") >= least) & (C("sa") > 1e-12) & (C("sb") > 1e-12))
    return g.groupBy(C("signal").alias("factor")).agg(F.avg(C("c") / (C("sa") * C("sb"))).alias("mean_ic"), F.count(F.lit(1)).alias("dates"))


def ic_weights(ics: DataFrame, static: dict[str, float], floor: float = 0.02, cap: float = 0.4, least: int = 20) -> DataFrame:
    """Weights in proportion to mean correlations of at least ``floor``, none above ``cap``; the windows see one row a factor.

    With the factors from the largest down, the first m are held at the cap and the others share what is left; m is the smallest number
    for which no other exceeds it. What remains when all that count are at the cap goes to the rest by their static weights. Without any
    that counts the static weights hold. Negative correlations and those over fewer than ``least`` dates don't count.
    """
    base = ics.sparkSession.createDataFrame(sorted(static.items()), "factor string, static double")
    d = base.join(F.broadcast(ics), "factor", "left")
    d = d.withColumn("g", F.when((C("dates") >= least) & (C("mean_ic") >= floor), C("mean_ic")).otherwise(0.0))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("g"), "factor")
    whole = Window.partitionBy(F.lit(0))
    d = d.withColumn("m", F.row_number().over(down) - 1).withColumn("rest", F.sum("g").over(down.rowsBetween(0, Window.unboundedFollowing)))
    share = (1 - C("m") * cap) * C("g") / C("rest")  # of the m-th, if all before it are at the cap
    d = d.withColumn("held", F.min(F.when((C("g") > 0) & (share <= cap + 1e-12), C("m"))).over(whole)).withColumn("live", F.sum((C("g") > 0).cast("int")).over(whole))
    d = d.withColumn("held", F.coalesce("held", "live")).withColumn("pool", F.sum(F.when(C("m") >= C("held"), C("g"))).over(whole))
    idle = F.sum(F.when(C("g") == 0, C("static"))).over(whole)
    left = F.greatest(1 - C("held") * cap, F.lit(0.0))
    weight = F.when(C("live") == 0, C("static")).when(C("m") < C("held"), cap).when(C("g") > 0, left * C("g") / C("pool")).when(C("held") == C("live"), left * C("static") / C("idle")).otherwise(0.0)
    return d.withColumn("idle", idle).select("factor", "mean_ic", "dates", F.round(weight, 4).alias("weight"), F.when(C("live") == 0, "static").otherwise("ic").alias("method"))
