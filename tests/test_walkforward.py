"""The feature frame, data set, folds, models and their measures, on small tables made by hand or checked against numpy and pandas."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import features, walkforward as wf


@pytest.fixture(scope="module")
def data(spark):
    """120 dates of ten names; x1 tells the forward return, the other features are noise or missing."""
    rng = random.Random(1)
    rows, n = [], 0
    for day in range(120):
        for name in range(10):
            x = {f: rng.gauss(0, 1) for f in features.FEATURES}
            x["rsi"] = rng.uniform(-1, 1)
            x["overnight_gap"] = None
            fwd = 0.05 * x["rsi"] + rng.gauss(0, 0.01)
            rows.append((name, date(2020, 1, 1) + timedelta(days=day), day, n, 1200, 1 if fwd > 0.01 else -1 if fwd < -0.01 else 0, x["rsi"] * 0.9, *(fwd * h / 20 for h in (1, 5, 10, 20)), *(x[f] for f in features.FEATURES)))
            n += 1
    schema = "symbol int, date date, day long, ordinal long, rows long, label int, linear double, fwd1 double, fwd5 double, fwd10 double, fwd20 double, " + ", ".join(f"{f} double" for f in features.FEATURES)
    return spark.createDataFrame(rows, schema).cache()


def test_purged_rows_are_in_no_fit(data):
    roles = wf.with_roles(data).toPandas()
    for fold, d in roles.groupby("fold"):
        test, train, purged = (d[d.role == r] for r in ("test", "train", "purged"))
        assert len(test) == 200 and test.ordinal.min() == 1200 - (6 - fold) * 200
        assert (train.empty or train.day.max() < test.day.min() - 20) and len(train) == max(0, (test.day.min() - 20) * 10)
        assert set(purged.day) == set(range(max(0, test.day.min() - 20), test.day.min()))
    counts = {r["fold"]: r for r in wf.fold_counts(data).collect()}
    assert counts[5]["train_rows"] == 800 and counts[5]["purged_rows"] == 200 and counts[1]["train_rows"] == 0


def test_walk_forward_scores_each_row_once_and_learns(data):
    scores = wf.walk_forward(data, trees=10, leaf=5).cache()
    d = scores.toPandas()
    assert not d.duplicated(["symbol", "date"]).any()
    assert sorted(d.fold.unique()) == [2, 3, 4, 5]  # fold 1 has no rows before the purge
    assert d.ml.corr(d.fwd20) > 0.8 and d.ml_regression.corr(d.fwd20) > 0.8 and d.ml_regression.between(-1, 1).all()
    out = wf.diagnostic(scores).toPandas().set_index(["track", "horizon", "fold"])
    pooled = out.loc[("linear", 20, 0)]
    assert pooled.n_obs == 800 and pooled.n_dates == 80
    assert pooled.pearson == pytest.approx(d.linear.corr(d.fwd20), abs=1e-9)
    assert pooled.spearman == pytest.approx(d.linear.rank().corr(d.fwd20.rank()), abs=1e-9)
    ics = d.groupby("date").apply(lambda g: g.linear.rank().corr(g.fwd20.rank()), include_groups=False)
    assert pooled.mean_ic == pytest.approx(ics.mean(), abs=1e-9) and pooled.std_ic == pytest.approx(ics.std(ddof=0), abs=1e-9)
    assert pooled.hit == pytest.approx((np.sign(d.linear) == np.sign(d.fwd20)).mean(), abs=1e-9)
    assert pooled.mean_of_folds == pytest.approx(np.mean([out.loc[("linear", 20, k)].mean_ic for k in (2, 3, 4, 5)]), abs=1e-9)


def test_metrics_of_few_or_constant_scores(spark):
    rows = [(1, date(2020, 1, 1 + k // 10), "t", 1, 0.0 if k < 60 else 0.5, float(k % 7) - 3) for k in range(60)] + [(2, date(2020, 2, 1), "t", 1, 1.0, 1.0)] * 10
    got = {r["fold"]: r for r in wf.track_metrics(spark.createDataFrame(rows, "fold int, date date, track string, horizon int, score double, fwd double"), ["track", "horizon", "fold"]).collect()}
    assert got[1]["pearson"] is None and got[1]["hit"] is None and got[1]["n_dates"] == 0 and got[1]["n_obs"] == 60
    assert got[2]["n_obs"] == 10 and got[2]["hit"] is None  # under 50 rows


def test_spread_rank_is_the_average_rank(spark):
    rng = random.Random(3)
    rows = [(k % 2, float(rng.choice([1, 1, 1, rng.random(), -5]))) for k in range(700)]
    d = wf.spread_rank(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", "r", parts=8).toPandas()
    assert np.allclose(d.r, d.groupby("g").x.rank())


def test_grid_search_prefers_the_better_setting(data):
    d = wf.grid_search(data.where("label != 0"), features=["rsi", "macd"], depths=(1, 5), leaves=(5, 300), folds=2, trees=5).toPandas()
    assert len(d) == 2 * 2 * 2 - (4 if d.fold.nunique() == 1 else 0)
    best = d[d.best].drop_duplicates(["max_depth", "min_leaf"])
    assert len(best) == 1 and best.mean_accuracy.iloc[0] == pytest.approx(d.mean_accuracy.max())


def test_meta_labels_are_probabilities_that_rank(data):
    d = wf.meta_scores(data, threshold=-0.9).toPandas()
    assert d.prob.between(0, 1).all() and not d.duplicated(["symbol", "date"]).any()
    assert d[d.prob > 0.8].profit.mean() > 0.85 and d[d.prob < 0.2].profit.mean() < 0.15
    sweep = wf.meta_sweep(data.sparkSession.createDataFrame(d), (0.5,)).toPandas().set_index("fold")
    assert sweep.loc[0].n == len(d) and sweep.loc[0].taken == (d.prob >= 0.5).sum()
    assert sweep.loc[0].uplift == pytest.approx(d[d.prob >= 0.5].profit.mean() - d.profit.mean())
    assert wf.meta_scores(data, threshold=5.0).count() == 0


def test_paths_hold_every_group_once(spark, data):
    assert wf.combination_counts(6, 2) == (15, 5)
    roles = wf.combination_roles(data, 6, 2).toPandas()
    for combo, d in roles.groupby("combo"):
        days = {g: (x.day.min(), x.day.max()) for g, x in d[d.role == "test"].groupby("group")}
        assert len(days) == 2
        for day in d[d.role == "train"].day.unique():
            assert all(day < a - 20 or day > b + 20 for a, b in days.values()), combo
    pieces = [(c, g, s, date(2020, 1, 1) + timedelta(days=g), float(s), float(s)) for c, picked in enumerate(__import__("itertools").combinations(range(6), 2)) for g in picked for s in range(6)]
    scores = spark.createDataFrame(pieces, "combo int, group int, symbol int, date date, fwd20 double, score double")
    paths = wf.backtest_paths(scores, 6, 2)
    seen = paths.select("path", "group", "combo").distinct().toPandas()
    assert sorted(map(tuple, seen[["path", "group"]].values.tolist())) == [(p, g) for p in range(5) for g in range(6)]
    assert seen[seen.group == 3].sort_values("path").combo.tolist() == sorted(seen[seen.group == 3].combo)
    assert paths.count() == len(pieces)
    with pytest.raises(ValueError, match="number of splits"):
        wf.backtest_paths(scores.where("combo > 0"), 6, 2)
    rets = wf.path_returns(paths, stride=1).toPandas()
    assert len(rets) == 30 and (rets.ret == 5.0).all()
    assert wf.path_summary(rets.pipe(lambda r: spark.createDataFrame(r.assign(ret=r.ret + r.index % 2)))).first()["paths"] == 5


def test_price_scores_match_pandas(spark):
    rng = np.random.default_rng(5)
    n = 200
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    close[50:55] = close[49]
    days = [date(2020, 1, 1) + timedelta(days=k) for k in range(n)]
    bars = spark.createDataFrame([("a", d, float(c), int(v), float(b)) for d, c, v, b in zip(days, close, rng.integers(1, 999, n), np.linspace(50, 60, n), strict=True)], "symbol string, date date, close double, volume long, bench_close double")
    got = features.price_scores(bars).toPandas().sort_values("date")
    c = pd.Series(close)
    delta = c.diff()
    mean = lambda x: x.ewm(com=13, min_periods=14).mean()
    rsi = 100 - 100 / (1 + mean(delta.where(delta > 0, 0.0)) / mean((-delta).where(delta < 0, 0.0)))
    assert np.allclose(got.rsi, ((rsi - 50) / 30).clip(-1, 1).fillna(0))
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    hist = line - line.ewm(span=9, adjust=False).mean()
    before = hist.shift(1)
    bonus = np.where((before < 0) & (hist > 0), 0.3, np.where((before > 0) & (hist < 0), -0.3, 0.0))
    assert np.allclose(got.macd, ((hist / c * 100).clip(-0.7, 0.7) + bonus).clip(-1, 1))
    up = (c / c.shift(63) - 1) - (pd.Series(np.linspace(50, 60, n)).pct_change(63))
    assert np.allclose(got.relative_strength, (up / 0.2).clip(-1, 1).fillna(0))


def test_calendar_takes_last_rows_and_keeps_their_nulls(spark):
    d = lambda k: date(2020, 1, k)
    days = spark.createDataFrame([(d(k),) for k in (2, 4, 6, 8)], "date date")
    one = spark.createDataFrame([(d(3), 1.0), (d(5), None), (d(8), 3.0)], "date date, value double")
    two = spark.createDataFrame([(d(1), 7.0)], "date date, value double")
    got = {r["date"]: (r["a"], r["b"]) for r in features.market_calendar(days, {"a": one, "b": two}).collect()}
    assert [got[d(k)] for k in (2, 4, 6, 8)] == [(None, 7.0), (1.0, 7.0), (None, 7.0), (3.0, 7.0)]


def test_feature_order_is_checked(spark):
    frame = spark.createDataFrame([], ", ".join(f"{f} double" for f in features.FEATURES))
    assert features.checked_features(frame) is frame and len(features.FEATURES) == 20
    with pytest.raises(ValueError):
        features.checked_features(frame.select(*reversed(features.FEATURES)))


def test_intraday_features_by_hand(spark):
    day = lambda k: date(2020, 1, 1) + timedelta(days=k)
    bars = spark.createDataFrame([("a", day(k), 10.0, 12.0, 8.0, 10.0, 5) for k in range(30)], "symbol string, date date, open double, high double, low double, close double, volume long")
    rows = [("a", day(k), m, 10.0, 12.0, 8.0, c, v) for k in range(20, 30) for m, c, v in ((555, 10.0, 100), (570, 10.0, 100 if k < 29 else 300), (855, 10.0, 50), (915, 11.0, 50))]
    got = features.intraday_features(spark.createDataFrame(rows, "symbol string, date date, minute int, open double, high double, low double, close double, volume long"), bars).toPandas().sort_values("date")
    assert got.date.tolist() == [day(k) for k in range(25, 30)]  # five days before with the candles
    last = got.iloc[-1]
    assert last.opening_drive_vol == 2.0 and last.closing_spike_vol == 1.0 and last.intraday_range_ratio == pytest.approx(1.0)
    assert last.overnight_gap == pytest.approx((10 - 11) / 11) and last.last_hour_momentum == pytest.approx(0.1) and last.vol_concentration == pytest.approx(300 / 500)


def test_effective_size(spark):
    w = spark.createDataFrame([(1.0,), (1.0,), (0.5,)], "weight double")
    assert wf.effective_size(w).first()["effective"] == pytest.approx(2.5**2 / 2.25)
    assert wf.effective_size(w.where(F.lit(False))).first()["effective"] is None
