"""Steps of op6 and op9 that need no shuffle or round of their own."""

from marlstone.llm import ngramjoin
from marlstone.llm.graph import _settled, components


def test_stars_are_known_as_settled_without_a_round(spark):
    edges = lambda rows: spark.createDataFrame(rows, "u long, v long")
    assert _settled(edges([])) and _settled(edges([(2, 1), (3, 1), (9, 8)]))
    assert not _settled(edges([(2, 1), (3, 2)])) and not _settled(edges([(3, 1), (3, 2)]))
    stars = spark.createDataFrame([(1, k) for k in range(2, 40)], "a long, b long")
    assert {tuple(r) for r in components(stars, most_rounds=1).collect()} == {(k, 1) for k in range(1, 40)}


def test_grams_that_occur_once_go_by_one_shuffle(spark):
    rows = spark.createDataFrame([(g, c) for g in range(50) for c in range(1 + g % 3)], "gram long, cid long")
    out = ngramjoin.shared_grams(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted(map(tuple, out.collect())) == [(g, c) for g in range(50) if g % 3 for c in range(1 + g % 3)]
