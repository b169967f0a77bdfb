"""Invariants of the market operators on small tables."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions.ewm import ewm_mean
from marlstone.functions.expr import norm_cdf
from marlstone.operators import align, backtest, labels, studies, upsert, xsection

D = dt.date(2020, 1, 1)


def day(k):
    return D + dt.timedelta(days=k)


def bars(spark, closes, symbol="a"):
    return spark.createDataFrame([(symbol, day(k), float(c)) for k, c in enumerate(closes)], "symbol string, date date, close double")


def test_ewm_matches_pandas_over_blocks(spark):
    x = [math.sin(k * 0.7) * 10 + k % 7 for k in range(200)]
    for adjust in (True, False):
        got = ewm_mean(bars(spark, x), "close", "y", 2 / 13, adjust, 5).orderBy("date").toPandas()["y"]
        want = pd.Series(x).ewm(span=12, adjust=adjust, min_periods=5).mean()
        assert got.isna().sum() == 4
        assert (got - want).abs().max() < 1e-9


def test_asof_takes_the_last_value_at_or_before(spark):
    left = bars(spark, [1, 1, 1, 1])
    right = spark.createDataFrame([(day(1), 10.0), (day(3), 30.0)], "date date, v double")
    got = [r["v"] for r in align.asof(left, right, "v", []).orderBy("date").collect()]
    assert got == [None, 10.0, 10.0, 30.0]


def test_nth_bar_returns_count_bars_after_the_entry(spark):
    b = bars(spark, [10, 11, 12, 13, 14, 15, 16])
    s = spark.createDataFrame([("a", day(1))], "symbol string, date date")
    r = align.nth_bar_returns(s, b, (1, 5)).first()
    assert r["entry"] == 11 and r["ret1"] == pytest.approx(12 / 11 - 1) and r["ret5"] == pytest.approx(16 / 11 - 1)


def test_membership_ends_are_included(spark):
    m = spark.createDataFrame([("i", "a", day(1), day(2)), ("i", "b", day(2), None)], "index_name string, symbol string, effective_from date, effective_to date")
    on = lambda k: sorted(r["symbol"] for r in align.members_on(m, str(day(k))).collect())
    assert [on(k) for k in range(4)] == [[], ["a"], ["a", "b"], ["b"]]
    panel = bars(spark, [1, 2, 3, 4])
    assert align.pit_filter(panel, m, "i").count() == 2


def test_upserts_differ_in_what_they_keep(spark):
    old = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "k int, a double, b double")
    new = spark.createDataFrame([(2, 9.0), (3, 8.0)], "k int, a double")
    as_set = lambda df: {tuple(r) for r in df.select("k", "a", "b").collect()}
    assert as_set(upsert.replace_rows(old, new, ["k"])) == {(1, 1.0, 2.0), (2, 9.0, None), (3, 8.0, None)}
    assert as_set(upsert.ignore_rows(old, new, ["k"])) == {(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 8.0, None)}
    assert as_set(upsert.update_columns(old, new, ["k"])) == {(1, 1.0, 2.0), (2, 9.0, 4.0), (3, 8.0, None)}


def test_information_coefficient_of_a_monotone_score_is_one(spark):
    p = spark.createDataFrame([(day(0), str(k), float(k), float(k * k)) for k in range(6)] + [(day(1), str(k), 1.0, float(k)) for k in range(6)], "date date, symbol string, s double, t double")
    got = {r["date"]: r["ic"] for r in xsection.ic_by_date(p, "s", "t").collect()}
    assert got[day(0)] == pytest.approx(1.0) and got[day(1)] is None


def test_triple_barrier_doesnt_look_beyond_its_path(spark):
    x = [100 * (1 + 0.01 * math.sin(k)) for k in range(80)]
    whole = {r["date"]: r["label"] for r in labels.barrier_labels(bars(spark, x)).collect()}
    cut = {r["date"]: r["label"] for r in labels.barrier_labels(bars(spark, x[:60])).collect()}
    assert cut and all(whole[d] == v for d, v in cut.items() if v is not None)
    up = {r["label"] for r in labels.barrier_labels(bars(spark, [100 * 1.02**k + (k % 2) for k in range(60)])).collect()}
    assert up == {1, None}


def test_uniqueness_of_coincident_and_lone_labels(spark):
    s = spark.createDataFrame([(1, day(0), day(2)), (2, day(0), day(2)), (3, day(10), day(11))], "id int, t0 date, t1 date")
    got = {r["id"]: r["weight"] for r in labels.uniqueness(s).collect()}
    assert got == {1: pytest.approx(0.5), 2: pytest.approx(0.5), 3: pytest.approx(1.0)}


def test_purged_folds_keep_train_away_from_test(spark):
    rows = labels.purged_folds(bars(spark, range(1, 101)), 5, 3, 2).toPandas()
    for k, f in rows.groupby("fold"):
        f = f.sort_values("date").reset_index(drop=True)
        test, train = f.index[f["role"] == "test"], f.index[f["role"] == "train"]
        assert len(test) == 20 and all(i < test.min() - 3 or i > test.max() + 2 for i in train)  # behind the test dates only the embargo is left out


def test_equity_pays_for_each_change_of_position(spark):
    s = bars(spark, [10, 11, 12, 12]).withColumn("signal", F.lit(1))
    r = backtest.equity(s, 0.01).orderBy("date").collect()
    assert [x["position"] for x in r] == [0, 1, 1, 1]
    assert r[1]["net"] == pytest.approx(0.1 - 0.01) and r[3]["equity"] == pytest.approx((1 + 0.09) * (1 + 1 / 11))


def test_norm_cdf(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (-3.0, -0.5, 0.0, 1.0, 2.5)], "x double").select(norm_cdf(F.col("x"))).collect()]
    want = [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in (-3.0, -0.5, 0.0, 1.0, 2.5)]
    assert got == pytest.approx(want, abs=1e-7)
