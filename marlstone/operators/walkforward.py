"""Models that learn only from the past: folds over the rows of a data set, purged fits, out-of-sample scores and what they are worth.

A data set is what ``features.training_set`` returns: its ordinals cut folds, its days (ordinals of dates) purge them. Every fit is one Spark job over
one fold; the loops run over folds and settings, never over rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.cut import cut
from marlstone.functions.expr import average_rank, clip
from marlstone.operators.features import FEATURES, PRICE
from marlstone.operators.xsection import rank_label

C = F.col
FOLDS, PURGE, LEAST_TRAIN, LEAST_TEST, LEAST_DATE = 5, 20, 200, 50, 3
HORIZONS = (1, 5, 10, 20)
# What the second model of the meta-labeler sees, and the settings that the grid search tries.
META_FEATURES = [*PRICE, "sector_rotation", "vix_regime", "nifty_trend", "markov_regime", "fii_fo_score"]
DEPTHS, LEAVES = (6, 8, 10, 12), (20, 30, 50, 80)
GRID_TREES = 300  # as many as the model has that the search is for
SWEEP = (0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)


def fold_bounds(data: DataFrame, folds: int = FOLDS, purge: int = PURGE) -> DataFrame:
    """(fold, lo, hi, from_day): fold k of n tests the k-th of the last n of n + 1 equal parts, ordinals [lo, hi), and learns from earlier rows whose day is before ``from_day``."""
    size = F.floor(C("rows") / (folds + 1))
    d = data.groupBy().agg(F.max("rows").alias("rows")).select("rows", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    d = d.select("fold", (C("rows") - (folds + 1 - C("fold")) * size).alias("lo"), (C("rows") - (folds - C("fold")) * size).alias("hi"))
    return d.join(data.select(C("ordinal").alias("lo"), "day"), "lo").select("fold", "lo", "hi", F.greatest(F.lit(0), C("day") - purge).alias("from_day"))


def with_roles(data: DataFrame, folds: int = FOLDS, purge: int = PURGE) -> DataFrame:
    """Every row once a fold with its role: train, purged or test; rows after the fold's test part have none."""
    d = data.crossJoin(F.broadcast(fold_bounds(data, folds, purge)))  # a row a fold
    role = F.when((C("ordinal") >= C("lo")) & (C("ordinal") < C("hi")), "test").when(C("ordinal") >= C("hi"), None).when(C("day") < C("from_day"), "train").otherwise("purged")
    return d.withColumn("role", role).where("role is not null").drop("lo", "hi", "from_day")


def fold_counts(data: DataFrame) -> DataFrame:
    """Rows by role, and the dates at which training ends and the test lies."""
    of = lambda r, x: F.when(C("role") == r, C(x))
    n = lambda r: F.count(of(r, "date"))
    return with_roles(data).groupBy("fold").agg(n("train").alias("train_rows"), n("purged").alias("purged_rows"), n("test").alias("test_rows"), F.max(of("train", "date")).alias("train_end"), F.min(of("test", "date")).alias("test_start"), F.max(of("test", "date")).alias("test_end"))


def weighted(train: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """Adds ``_w``: the row's weight over its class's share of all weight, so that classes weigh alike."""
    w = C(weight) if weight else F.lit(1.0)
    by = train.groupBy(label).agg(F.sum(w).alias("_k"))
    total = by.agg(F.sum("_k").alias("_n"), F.count(F.lit(1)).alias("_c"))
    return train.join(F.broadcast(by.crossJoin(total)), label).withColumn("_w", w * C("_n") / (C("_c") * C("_k"))).drop("_n", "_c", "_k")


def effective_size(weights: DataFrame, weight: str = "weight", by: tuple[str, ...] = ()) -> DataFrame:
    """(sum w)^2 / sum w^2 and the number of rows."""
    return weights.groupBy(*by).agg(F.count(weight).alias("n"), (F.sum(weight) * F.sum(weight) / F.sum(C(weight) * C(weight))).alias("effective"))


def _prepared(features: list[str]) -> list:
    filled = [f"_f_{f}" for f in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x", handleInvalid="keep")]


def _fillable(train: DataFrame, features: list[str]) -> list[str]:
    """The features that have a value at all: one that has none has no median."""
    seen = train.agg(*(F.count(f).alias(f) for f in features)).first()
    return [f for f in features if seen[f]]


def _classifier(depth: int, leaf: int, trees: int) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="_y", featuresCol="_x", weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=42, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_raw")


def _classes(train: DataFrame, weight: str | None = None) -> DataFrame:
    return weighted(train.withColumn("_y", (C("label") + 1).cast("double")), "_y", weight)


def forest(train: DataFrame, features: list[str], depth: int = 8, leaf: int = 30, trees: int = 50, weight: str | None = None):
    """A forest of three classes on median-filled features, classes weighted evenly."""
    f = _fillable(train, features)
    return Pipeline(stages=[*_prepared(f), _classifier(depth, leaf, trees)]).fit(_classes(train, weight))


def class_scores(model, rows: DataFrame, out: str = "ml") -> DataFrame:
    """Adds P(1) - P(-1)."""
    p = vector_to_array("_p")
    scored = model.transform(rows).withColumn(out, F.get(p, 2) - F.get(p, 0))
    return scored.select(*rows.columns, out)


def rank_forest(train: DataFrame, features: list[str], depth: int = 8, leaf: int = 30, trees: int = 50):
    """A forest that learns ``rank_label``, a row's rank among its date's forward returns on [-1, 1]."""
    known = train.where("rank_label is not null")
    f = _fillable(known, features)
    model = RandomForestRegressor(labelCol="rank_label", featuresCol="_x", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=42, predictionCol="_r")
    return Pipeline(stages=[*_prepared(f), model]).fit(known)


def rank_scores(model, rows: DataFrame, out: str = "ml_regression") -> DataFrame:
    return model.transform(rows).select(*rows.columns, clip(C("_r"), -1, 1).alias(out))


def ranked(data: DataFrame, target: str = "fwd20") -> DataFrame:
    """Adds ``rank_label``; null on dates with few rows."""
    r = rank_label(data.select("date", "symbol", target), target)
    return data.join(r.select("date", "symbol", "rank_label"), ["date", "symbol"], "left")


def walk_forward(data: DataFrame, features: list[str] = FEATURES, trees: int = 50, depth: int = 8, leaf: int = 30) -> DataFrame:
    """(fold, symbol, date, forward returns, ml, linear, ml_regression) of every row of a test part, each scored once by models that end before its fold less the purge.

    Folds with fewer than ``LEAST_TRAIN`` rows to learn from, or without both a rise and a fall among them, are left out; so are ranks where too few rows have one.
    """
    data = cut(ranked(data))
    roles = with_roles(data)
    facts = roles.where("role = 'train'").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("rank_label").alias("ranks"))
    out = []
    for r in facts.orderBy("fold").collect():  # a row a fold
        if r["n"] < LEAST_TRAIN or r["low"] != -1 or r["high"] != 1:
            continue
        train, test = (roles.where((C("fold") == r["fold"]) & (C("role") == k)) for k in ("train", "test"))
        scored = class_scores(forest(train, features, depth, leaf, trees), test)
        scored = rank_scores(rank_forest(train, features, depth, leaf, trees), scored) if r["ranks"] >= LEAST_TRAIN else scored.withColumn("ml_regression", F.lit(None).cast("double"))
        out.append(scored.select("fold", "symbol", "date", *(f"fwd{h}" for h in HORIZONS), "ml", "linear", "ml_regression"))
    if not out:
        empty = data.limit(0).select(F.lit(0).alias("fold"), "symbol", "date", *(f"fwd{h}" for h in HORIZONS), F.lit(0.0).alias("ml"), "linear", F.lit(0.0).alias("ml_regression"))
        return empty
    return cut(reduce(DataFrame.unionByName, out))


TRACKS = ("ml", "linear", "ml_regression")


def to_tracks(scores: DataFrame, tracks: tuple[str, ...] = TRACKS, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(fold, date, track, horizon, score, fwd), without rows that lack one of both."""
    pairs = F.array(*(F.struct(F.lit(t).alias("track"), F.lit(h).alias("horizon"), C(t).alias("score"), C(f"fwd{h}").alias("fwd")) for t in tracks for h in horizons))
    return scores.select("fold", "date", F.explode(pairs).alias("x")).select("fold", "date", "x.*").where("score is not null and fwd is not null")


def spread_rank(rows: DataFrame, by: list[str], value: str, out: str, parts: int = 64) -> DataFrame:
    """Adds the average rank of ``value`` among the rows of ``by``, however many: rows are cut into ranges of the value, ranked within, and
    moved up by the number of rows in lower ranges. Equal values share a range, so results don't depend on where the cuts lie."""
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, F.array(*(F.lit(k / parts) for k in range(1, parts))), 1000).alias("_cuts"))
    d = rows.join(F.broadcast(cuts), by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < C(value)))).drop("_cuts")
    below = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    size = d.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_part", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    return d.join(F.broadcast(size), [*by, "_part"]).withColumn(out, C("_below") + average_rank(C(value), [*by, "_part"])).drop("_part", "_below")


def _corr(x: str, y: str) -> Column:
    """Null where one of both is constant."""
    return F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def track_metrics(long: DataFrame, by: list[str]) -> DataFrame:
    """By group: mean and deviation of the rank correlations by date, their ratio, pooled correlations, the share of right signs among calls, rows and dates.

    Groups with fewer than ``LEAST_TEST`` rows have numbers of rows only. Dates with fewer than ``LEAST_DATE`` rows don't count.
    """
    day = [*by, "date"]
    r = long.withColumns({"_a": average_rank(C("score"), day), "_b": average_rank(C("fwd"), day)})
    ics = r.groupBy(*day).agg(F.count(F.lit(1)).alias("_n"), _corr("_a", "_b").alias("ic")).where(C("_n") >= LEAST_DATE)
    ics = ics.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("std_ic"), F.count("ic").alias("n_dates"))
    pool = spread_rank(spread_rank(long, by, "score", "_a"), by, "fwd", "_b")
    call = (F.signum("score") != 0) & (F.signum("fwd") != 0)
    pooled = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"), _corr("score", "fwd").alias("pearson"), _corr("_a", "_b").alias("spearman"), F.avg(F.when(call, (F.signum("score") == F.signum("fwd")).cast("double"))).alias("hit"))
    enough = C("n_obs") >= LEAST_TEST
    d = pooled.join(ics, by, "left")
    ratio = F.when(C("std_ic") > 1e-9, C("mean_ic") / C("std_ic"))
    keep = {"mean_ic": C("mean_ic"), "std_ic": C("std_ic"), "icir": ratio, "pearson": C("pearson"), "spearman": C("spearman"), "hit": C("hit")}
    return d.select(*by, "n_obs", F.when(enough, F.coalesce("n_dates", F.lit(0))).otherwise(0).cast("long").alias("n_dates"), *(F.when(enough, x).alias(k) for k, x in keep.items()))


def diagnostic(scores: DataFrame) -> DataFrame:
    """Metrics of each track and horizon by fold (fold 1 to n) and over all folds (fold 0), with the mean and deviation of the folds' means on the latter."""
    long = to_tracks(scores)
    folds = track_metrics(long, ["track", "horizon", "fold"])
    pooled = track_metrics(long, ["track", "horizon"]).withColumn("fold", F.lit(0))
    spread = folds.groupBy("track", "horizon").agg(F.avg("mean_ic").alias("mean_of_folds"), F.stddev_pop("mean_ic").alias("std_of_folds"), F.avg("hit").alias("hit_of_folds"))
    return pooled.join(spread, ["track", "horizon"], "left").unionByName(folds, allowMissingColumns=True)


def grid_search(data: DataFrame, features: list[str] = FEATURES, depths: tuple[int, ...] = DEPTHS, leaves: tuple[int, ...] = LEAVES, folds: int = FOLDS, trees: int = GRID_TREES) -> DataFrame:
    """(max_depth, min_leaf, fold, n_train, n_test, accuracy, mean_accuracy, best): every setting on every fold, fitted on purged rows.

    Of settings with equal means the first tried is best: smaller depth, then smaller leaves. A fold's rows are filled and weighted once for all
    settings, and each model is let go of when its test rows are scored: the driver holds one forest and a row a setting and fold.
    """
    roles = cut(with_roles(data, folds))
    rows = []
    for fold in range(1, folds + 1):
        train, test = (roles.where((C("fold") == fold) & (C("role") == k)) for k in ("train", "test"))
        if train.isEmpty():
            continue
        filled = Pipeline(stages=_prepared(_fillable(train, features))).fit(train)
        train, test = cut(_classes(filled.transform(train)).select("_x", "_y", "_w")), cut(filled.transform(test).select("_x", "label"))
        for depth in depths:
            for leaf in leaves:
                hit = _classifier(depth, leaf, trees).fit(train).transform(test).agg(F.avg((C("_c") - 1 == C("label")).cast("double")), F.count(F.lit(1))).first()
                rows.append((depth, leaf, fold, hit[1], hit[0]))
    tried = data.sparkSession.createDataFrame(rows, "max_depth int, min_leaf int, fold int, n_test long, accuracy double")
    counts = roles.where("role = 'train'").groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"))
    d = tried.join(counts, "fold").select("fold", "max_depth", "min_leaf", "n_test", "accuracy", "n_train").withColumn("mean_accuracy", F.avg("accuracy").over(Window.partitionBy("max_depth", "min_leaf")))
    return d.withColumn("best", F.dense_rank().over(Window.orderBy(F.desc(F.round("mean_accuracy", 12)), "max_depth", "min_leaf")) == 1)  # a row a setting and fold


# -- meta-labels ---------------------------------------------------------------------------------------------------------------------------


def calibrated(train: DataFrame, rows: DataFrame, features: list[str] = META_FEATURES, parts: int = 3) -> DataFrame:
    """Adds ``prob`` to ``rows``: P(profit) by a logistic model on filled and scaled features, calibrated by isotonic regression.

    Training rows are cut into ``parts``, class by class in order of their ordinals. For each part a logistic model learns from the others and an isotonic
    one from its margins on the part; ``prob`` is the mean of the calibrated models.
    """
    f = _fillable(train, features)
    n = train.count()
    own = Window.partitionBy("profit").orderBy("ordinal")
    prepared = Pipeline(stages=[*_prepared(f), StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True)]).fit(train)
    d = train.withColumn("_part", F.floor((F.row_number().over(own) - 1) * parts / F.count(F.lit(1)).over(Window.partitionBy("profit"))))
    d, out = cut(prepared.transform(d).select("profit", "_part", "_z")), prepared.transform(rows).select(*rows.columns, "_z")
    margin = lambda m: vector_to_array(m)[1]
    for k in range(parts):
        # the penalty is one over the number of rows, as it is weighed against the mean loss
        fitted = LogisticRegression(featuresCol="_z", labelCol="profit", regParam=1.0 / max(1, n * (parts - 1) // parts), maxIter=200, rawPredictionCol="_raw", probabilityCol="_pr", predictionCol="_pc").fit(d.where(C("_part") != k))
        seen = fitted.transform(d.where(C("_part") == k)).select("profit", margin("_raw").alias("_margin"))
        iso = IsotonicRegression(featuresCol="_margin", labelCol="profit", predictionCol=f"_iso{k}").fit(seen)
        out = iso.transform(fitted.transform(out).withColumn("_margin", margin("_raw")).drop("_raw", "_pr", "_pc")).drop("_margin")
    prob = sum((C(f"_iso{k}") for k in range(parts)), F.lit(0.0)) / parts
    return out.select(*rows.columns, prob.alias("prob"))


def meta_scores(data: DataFrame, threshold: float = 0.4, primary: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None, least_share: float = 0.05) -> DataFrame:
    """(fold, symbol, date, primary, prob, profit, fwd20) of the test rows that the primary score calls, each by a second model fitted on the purged training rows that it calls.

    ``primary`` maps a fold's (train, test) to both with a column ``primary``; the linear score, if not given. Folds with too few calls, or calls of
    one outcome almost alone, are left out.
    """
    data = cut(data.withColumn("profit", (C("fwd20") > 0).cast("double")))
    roles, out = with_roles(data), []
    for fold in range(1, FOLDS + 1):
        train, test = (roles.where((C("fold") == fold) & (C("role") == k)) for k in ("train", "test"))
        train, test = primary(train, test) if primary else (train.withColumn("primary", C("linear")), test.withColumn("primary", C("linear")))
        train, test = cut(train.where(C("primary") >= threshold)), test.where(C("primary") >= threshold)
        seen = train.agg(F.count(F.lit(1)).alias("n"), F.avg("profit").alias("share")).first()
        if seen["n"] < LEAST_TRAIN or test.count() < LEAST_TEST or not least_share <= seen["share"] <= 1 - least_share:
            continue
        out.append(calibrated(train, test).select("fold", "symbol", "date", "primary", "prob", "profit", "fwd20"))
    if not out:
        return data.limit(0).select(F.lit(0).alias("fold"), "symbol", "date", C("linear").alias("primary"), F.lit(0.0).alias("prob"), "profit", "fwd20")
    return cut(reduce(DataFrame.unionByName, out))


def rank_primary(trees: int = 50) -> Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """The regression track as the primary score; its ranks are made within the fold's training rows."""

    def scores(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        model = rank_forest(ranked(train), FEATURES, trees=trees)
        return rank_scores(model, train, "primary"), rank_scores(model, test, "primary")

    return scores


def meta_sweep(scores: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """For each threshold, by fold and over all (fold 0): how the calls with a probability of at least the threshold do against all calls."""
    both = scores.unionByName(scores.withColumn("fold", F.lit(0)))
    d = both.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    take = C("prob") >= C("threshold")
    kept = lambda x: F.when(take, C(x))
    d = d.groupBy("threshold", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg("profit").alias("base_hit"), F.avg("fwd20").alias("base_return"), F.stddev_pop("fwd20").alias("_s"),
        F.count(kept("prob")).alias("taken"), F.avg(kept("profit")).alias("hit"), F.avg(kept("fwd20")).alias("mean_return"), F.stddev_pop(kept("fwd20")).alias("_t"),
    )
    sharpe = lambda m, s: F.when(C(s) > 1e-9, C(m) / C(s))
    return d.select("threshold", "fold", "n", "taken", "base_hit", "hit", (C("hit") - C("base_hit")).alias("uplift"), "base_return", "mean_return", sharpe("base_return", "_s").alias("base_sharpe"), sharpe("mean_return", "_t").alias("sharpe"))


# -- combinatorial splits ------------------------------------------------------------------------------------------------------------------


def combination_counts(groups: int, tested: int) -> tuple[int, int]:
    """Splits, and whole paths that their test pieces make."""
    return math.comb(groups, tested), math.comb(groups - 1, tested - 1)


def combination_roles(data: DataFrame, groups: int = 6, tested: int = 2, purge: int = PURGE) -> DataFrame:
    """Every row once a split with its group and role; groups are runs of ordinals, and rows within ``purge`` days of a tested group are purged."""
    chosen = [(k, list(c)) for k, c in enumerate(combinations(range(groups), tested))]
    combos = data.sparkSession.createDataFrame(chosen, "combo int, picked array<int>")
    d = data.withColumn("group", F.least(F.lit(groups - 1), F.floor(C("ordinal") * groups / C("rows"))).cast("int"))
    spans = F.broadcast(d.groupBy().agg(*(F.struct(F.min(F.when(C("group") == g, C("day"))).alias("a"), F.max(F.when(C("group") == g, C("day"))).alias("b")).alias(f"_g{g}") for g in range(groups))))
    d = d.crossJoin(spans).crossJoin(F.broadcast(combos))  # one row of spans; as many rows as splits
    span = F.array(*(C(f"_g{g}") for g in range(groups)))
    near = F.exists("picked", lambda g: (C("day") >= F.get(span, g)["a"] - purge) & (C("day") <= F.get(span, g)["b"] + purge))
    role = F.when(F.array_contains("picked", C("group")), "test").when(near, "purged").otherwise("train")
    return d.withColumn("role", role).drop(*(f"_g{g}" for g in range(groups)), "picked")


def combinatorial_scores(data: DataFrame, groups: int = 6, tested: int = 2, features: list[str] = FEATURES, trees: int = 20, depth: int = 8, leaf: int = 30) -> DataFrame:
    """(combo, group, symbol, date, fwd20, score): every tested row of every split, scored by a rank forest on the rows that the split leaves to learn from."""
    roles = combination_roles(cut(ranked(data)), groups, tested)
    out = []
    for combo in range(combination_counts(groups, tested)[0]):
        train, test = (roles.where((C("combo") == combo) & (C("role") == k)) for k in ("train", "test"))
        out.append(rank_scores(rank_forest(train, features, depth, leaf, trees), test, "score").select("combo", "group", "symbol", "date", "fwd20", "score"))
    return cut(reduce(DataFrame.unionByName, out))


def backtest_paths(scores: DataFrame, groups: int = 6, tested: int = 2) -> DataFrame:
    """Adds ``path``: a group's splits, in order, go to the paths 0, 1, ... in turn, so that each path holds every group once.

    An error if a group lacks the splits that it must have: paths of a part of all splits would have holes.
    """
    pieces = scores.select("group", "combo").distinct()
    path = pieces.withColumn("path", F.row_number().over(Window.partitionBy("group").orderBy("combo")) - 1)  # a row a group and split
    want = combination_counts(groups, tested)[1]
    found = {r["group"]: r["count"] for r in pieces.groupBy("group").count().collect()}
    if wrong := {g: found.get(g, 0) for g in range(groups) if found.get(g, 0) != want}:
        raise ValueError(f"groups with another number of splits than {want}: {wrong}")
    return scores.join(F.broadcast(path), ["group", "combo"])


def path_returns(paths: DataFrame, share: float = 0.2, least: int = 5, stride: int = 20) -> DataFrame:
    """(path, date, ret): on every ``stride``-th date of a path the mean forward return of the top share of scores less that of the bottom one."""
    w = lambda *o: Window.partitionBy("path", "date").orderBy(*o)
    d = paths.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy("path", "date")), "_hi": F.row_number().over(w(F.desc("score"), "symbol")), "_lo": F.row_number().over(w("score", "symbol"))}).where(C("_n") >= least)
    k = F.greatest(F.lit(1), F.floor(C("_n") * share))
    legs = d.groupBy("path", "date").agg((F.avg(F.when(C("_hi") <= k, C("fwd20"))) - F.avg(F.when(C("_lo") <= k, C("fwd20")))).alias("ret"))
    return legs.withColumn("_i", F.row_number().over(Window.partitionBy("path").orderBy("date")) - 1).where(C("_i") % stride == 0).drop("_i")


def path_summary(returns: DataFrame, per_year: float = 12.6) -> DataFrame:
    """Over the paths' Sharpe ratios: mean, deviation, median, the 5 % and 95 % points, and the share above 0. Paths with fewer than three returns don't count."""
    s = returns.groupBy("path").agg(F.count("ret").alias("n"), (F.avg("ret") / F.when(F.stddev_samp("ret") > 0, F.stddev_samp("ret")) * math.sqrt(per_year)).alias("sharpe")).where("n >= 3")
    return s.agg(F.count("sharpe").alias("paths"), F.avg("sharpe").alias("mean"), F.stddev_pop("sharpe").alias("std"), F.percentile("sharpe", F.lit(0.5)).alias("median"), F.percentile("sharpe", F.lit(0.05)).alias("q05"), F.percentile("sharpe", F.lit(0.95)).alias("q95"), F.avg((C("sharpe") > 0).cast("double")).alias("above_zero"))
