"""What keeps queries in proportion to their input: nothing is scored, parsed or aggregated once more than needed."""

import re

import pytest
from pyspark.sql import functions as F

from marlstone import catalog
from marlstone.operators import history, research, sentiment
from marlstone.sources import adapters

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_of_a_batch_are_not_held_against_all_scores(spark):
    n = 3000
    text = '{"scores": [' + ", ".join(f'{{"i": {k}, "score": {k % 3 - 1}}}' for k in [*range(-1, n + 2), 7, 8]) + ', null, {"i": 8, "score": 5}]}'
    d = sentiment.batch_scores(spark.createDataFrame([(1, text, n), (2, "nothing", 2), (3, None, 1), (4, text, 0)], "k int, text string, expected int"))
    got = {(r["k"], r["i"]): r["score"] for r in d.collect()}
    assert got == {(1, k): float(k % 3 - 1) for k in range(n)} | {(2, 0): None, (2, 1): None, (3, 0): None}
    assert "lambdafunction" not in plan(d).split("Generate")[0]  # no search after the items became rows


def test_an_article_is_scored_once(spark):
    d = catalog.queries()["sentiment_daily"](spark, SF)
    assert len(re.findall(r"split\(lower\(", plan(d))) == 1
    rows = spark.createDataFrame([("a", 1, "x", 0.5, "r"), ("a", 1, "", None, "z"), ("b", 1, "y", None, "r")], "symbol string, date int, source string, score double, scorer string")
    assert [tuple(r) for r in sentiment.daily_sentiment(rows).collect()] == [("a", 1, 0.5, 1, "x", "r")]


def test_a_deal_line_is_parsed_once(spark):
    assert plan(catalog.queries()["parsed_deals"](spark, SF)).count("from_csv") == 1
    texts = ["2001-02-03", " 2001-02-03 ", "12001-02-03", "03-Feb-2001", "03-feb-2001", "3-Feb-2001", "03/02/2001", "Feb 3, 2001", "Feb 13, 2001", "2001-2-3", "31/02/2001", "x", "", None, "01-02-2001", "2001-02-03x"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*(F.try_to_timestamp(F.trim("t"), F.lit(f)).cast("date") for f in history.DATE_FORMATS))
    assert [r for r in d.select("t", history.parse_dates(F.col("t")).cast("string")).collect()] == [tuple(r) for r in d.select("t", plain.cast("string")).collect()]
    lines = spark.createDataFrame([('03-Feb-2001,1,c,sell,"1,000","2.50"',), ("date,symbol,client,side,quantity,price",), (None,)], "text string")
    assert [str(r["date"]) + r["side"] + str(r["quantity"]) for r in research.parse_deals(lines).collect()] == ["2001-02-03SELL1000.0"]


@pytest.mark.parametrize("name", ["bars", "sessions"])
def test_bars_are_aggregated_without_sorting_line_items(spark, name):
    d = adapters.table(spark, SF, name)
    assert "Window" not in plan(d)
    used = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "supplier")}
    want = spark.sql(adapters.SQL[name], **used)
    assert d.dtypes == want.dtypes and sorted(map(str, d.collect())) == sorted(map(str, want.collect()))


def test_a_query_of_models_aggregates_a_table_once(spark):
    asked = []

    def t(name):
        asked.append(name)
        return adapters.table(spark, SF, name)

    data = catalog._training(t)
    assert asked.count("bars") == asked.count("bench") == asked.count("market_regime") == 1
    assert "Relation" not in plan(data) and "Join" not in plan(data)  # the data set itself is written: fits don't make it anew
