"""Labels from forward paths, weights for overlapping labels, purged splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.cut import cut
from marlstone.functions.ewm import ewm_std
from marlstone.functions.expr import by_symbol, change

C = F.col


def barrier_labels(bars: DataFrame, days: int = 20, width: float = 2.5, cost: float = 0.0015, span: int = 20, least: int = 10) -> DataFrame:
    """1, -1 or 0 by the barrier that the path of ``days`` closes meets first, and after how many bars. Barriers lie ``width`` exponentially weighted deviations of
    daily returns off, ``cost`` at least; one return net of costs is held against both.

    Every bar has its row: label and bars_held are null before ``least`` returns and where the path is not whole.
    """
    d = bars.select("symbol", "date", "close", change(C("close"), 1).alias("_r")).withColumn("path", F.collect_list("close").over(by_symbol().rowsBetween(1, days)))
    d = ewm_std(d, "_r", "_v", span, least).withColumn("w", F.greatest(width * C("_v"), F.lit(cost)))
    net = F.transform("path", lambda p: p / C("close") - 1 - cost)
    side = F.transform(net, lambda x: F.when(x >= C("w"), 1).when(x <= -C("w"), -1).otherwise(0))
    d = d.withColumn("_s", side).withColumn("_at", F.array_position(F.transform("_s", lambda s: s != 0), True))
    known = (F.size("path") == days) & C("_v").isNotNull() & (C("w") > 0)
    label = F.when(C("_at") > 0, F.element_at("_s", F.greatest(C("_at"), F.lit(1)).cast("int"))).otherwise(0)
    return d.select("symbol", "date", F.when(known, label).alias("label"), F.when(known, F.when(C("_at") > 0, C("_at")).otherwise(days)).cast("long").alias("bars_held"))


def label_spans(bars: DataFrame, events: DataFrame, days: int = 20) -> DataFrame:
    """(symbol, t0, t1) of every labelled bar: from its date to the date of the bar ``bars_held`` later."""
    ahead = bars.select("symbol", "date", F.collect_list("date").over(by_symbol().rowsBetween(1, days)).alias("_ahead"))
    held = events.where(C("label").isNotNull()).select("symbol", "date", C("bars_held").cast("int").alias("_held"))
    return ahead.join(held, ["symbol", "date"]).select("symbol", C("date").alias("t0"), F.element_at("_ahead", C("_held")).alias("t1"))


def uniqueness(spans: DataFrame) -> DataFrame:
    """Mean of 1 / (labels alive) over each label's span of dates [t0, t1]; the calendar is the distinct t0.

    Alive labels come from differences at both ends, span means from prefix sums: no label is exploded over its days. The
    one window without a key runs over the calendar only.
    """
    spans = cut(spans)
    calendar = cut(spans.select(C("t0").alias("d")).distinct().withColumn("o", F.row_number().over(Window.orderBy("d"))))
    ends = spans.join(F.broadcast(calendar.select(C("d").alias("t0"), C("o").alias("s"))), "t0")  # a row a date
    from marlstone.operators.align import asof

    days = asof(ends.select(C("t1").alias("date")).distinct(), calendar.select(C("d").alias("date"), "o"), "o", [], "date", "e")
    last = ends.withColumn("date", C("t1")).join(F.broadcast(days), "date").drop("date")
    change_at = last.select(C("s").alias("o"), F.lit(1).alias("x")).unionByName(last.select((C("e") + 1).alias("o"), F.lit(-1).alias("x"))).groupBy("o").agg(F.sum("x").alias("x"))
    run = Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    alive = calendar.join(F.broadcast(change_at), "o", "left").select("o", F.sum(F.coalesce("x", F.lit(0))).over(run).alias("c")).select("o", "c", F.sum(F.when(C("c") > 0, 1.0 / C("c")).otherwise(0.0)).over(run).alias("p"))
    alive = cut(alive)
    out = last.join(F.broadcast(alive.select(C("o").alias("e"), C("p").alias("pe"))), "e").join(F.broadcast(alive.select((C("o") + 1).alias("s"), C("p").alias("ps"))), "s", "left")
    return out.select(*[c for c in spans.columns if c != "_id"], ((C("pe") - F.coalesce("ps", F.lit(0.0))) / (C("e") - C("s") + 1)).alias("weight"))


def purged_folds(dates: DataFrame, folds: int = 5, label_days: int = 20, embargo: int = 20) -> DataFrame:
    """(fold, date, role) for every date and fold: test, train, or purged where a label or the embargo would reach into the test dates.

    Folds are runs of the sorted dates, of fold k from floor(k n / folds) on.
    """
    w = Window.orderBy("date")
    d = dates.select("date").distinct().withColumn("o", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("a", F.floor(C("fold") * C("n") / folds)).withColumn("b", F.floor((C("fold") + 1) * C("n") / folds))
    role = F.when((C("o") >= C("a")) & (C("o") < C("b")), "test").when((C("o") >= C("a") - label_days) & (C("o") < C("b") + embargo), "purged").otherwise("train")
    return d.select("fold", "date", role.alias("role"))


def combinatorial_splits(dates: DataFrame, groups: int = 6, tested: int = 2, label_days: int = 20, embargo: int = 20) -> DataFrame:
    """(combo, date, role) for every choice of ``tested`` of the groups: purged on both sides of every tested group. Combos are numbered in lexical order."""
    w = Window.orderBy("date")
    d = dates.select("date").distinct().withColumn("o", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    from itertools import combinations

    chosen = [(k, list(c)) for k, c in enumerate(combinations(range(groups), tested))]
    combos = dates.sparkSession.createDataFrame(chosen, "combo int, picked array<int>")
    low = lambda g: F.floor(g * C("n") / groups)
    high = lambda g: F.floor((g + 1) * C("n") / groups)
    x = d.crossJoin(F.broadcast(combos))  # as many rows as C(groups, tested), whatever the data
    test = F.exists("picked", lambda g: (C("o") >= low(g)) & (C("o") < high(g)))
    near = F.exists("picked", lambda g: (C("o") >= low(g) - label_days) & (C("o") < high(g) + embargo))
    return x.select("combo", "date", F.when(test, "test").when(near, "purged").otherwise("train").alias("role"))
