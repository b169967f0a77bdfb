"""Scores out of replies, chains of scorers, daily sentiment and its features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.expr import by_symbol, clip, let

C = F.col
NUMBER = r"-?\d*\.?\d+"
SOFT_CAP = 50.0  # so many articles count as 1


def four_places(x: Column) -> Column:
    """Rounded to four places, the noise of sums taken off first, as means of such numbers often end in a five."""
    return F.round(F.round(x, 9), 4)


def _in_range(x: Column) -> Column:
    return let(x, lambda v: F.when((v >= -1) & (v <= 1), v))


def _json_score(text: Column) -> Column:
    """The number under ``score`` of a JSON object, be it written as a number or as text."""
    return _in_range(F.get_json_object(text, "$.score").try_cast("double"))


def reply_score(text: Column) -> Column:
    """A score in [-1, 1] out of a reply: the JSON object that it is, else the first object with a numeric ``score`` in it, else its first number; null without any in range."""
    inside = F.regexp_extract(text, r'\{[^{}]*"score"\s*:\s*(' + NUMBER + r")[^{}]*\}", 1)
    return F.coalesce(_json_score(text), _in_range(inside.try_cast("double")), _in_range(F.regexp_extract(text, f"({NUMBER})", 1).try_cast("double")))


def batch_scores(replies: DataFrame) -> DataFrame:
    """(every column but text, i, score): a row an item of replies (..., text, expected) to a batch, i from 0; items without a valid score are null.

    A reply is {"scores": [{"i": .., "score": ..}, ...]}, with or without prose around it. Of several scores of an item the last valid one counts.
    """
    shape = "struct<scores:array<string>>"
    embedded = F.when(C("text").contains('"scores"'), F.regexp_extract("text", r'(?s)(\{.*"scores"\s*:.*\})', 1))
    entries = F.coalesce(F.from_json("text", shape)["scores"], F.from_json(embedded, shape)["scores"])
    index, score = (lambda e: F.regexp_extract(F.get_json_object(e, "$.i"), r"^(-?\d+)$", 1).try_cast("int")), (lambda e: _json_score(e))
    named = F.transform(entries, lambda e, at: F.struct(index(e).alias("i"), at.alias("at"), score(e).alias("score")))
    valid = F.filter(named, lambda e: (e["i"] >= 0) & (e["i"] < C("expected")) & e["score"].isNotNull())
    # every item stands before its scores; sorted, the last of an item's run is its answer, so a reply costs no square of its items
    blank = lambda i: F.struct(i.alias("i"), F.lit(-1).alias("at"), F.lit(None).cast("double").alias("score"))
    items = F.transform(F.sequence(F.lit(0), (C("expected") - 1).cast("int")), blank)
    keep = [c for c in replies.columns if c not in ("text", "expected")]
    d = replies.where("expected > 0").select(*keep, F.sort_array(F.concat(items, F.coalesce(valid, F.array_repeat(blank(F.lit(0)), 0)))).alias("_v"))
    last = F.filter("_v", lambda e, k: F.coalesce(F.get("_v", k + 1)["i"] != e["i"], F.lit(True)))
    return d.select(*keep, F.inline(last)).drop("at")


def chain_scores(rows: DataFrame, scorers: list[tuple[str, Column, float, float]]) -> DataFrame:
    """Adds score and scorer: of (name, score, low, high) in order of preference the first that isn't null, cut to its range."""
    told = lambda name, low, high: lambda v: F.when(v.isNotNull(), F.struct(clip(v.cast("double"), low, high).alias("score"), F.lit(name).alias("scorer")))
    first = F.coalesce(*(let(x, told(name, low, high)) for name, x, low, high in scorers))
    return rows.withColumn("_s", first).withColumns({"score": C("_s.score"), "scorer": C("_s.scorer")}).drop("_s")


def distinct_articles(*sources: DataFrame) -> DataFrame:
    """The union of sources (symbol, ts, source, url, title, ...): of a symbol's articles with one url, or one title where there is none, the first by source order and time stays."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_o", F.lit(k)) for k, s in enumerate(sources)])
    columns = [c for c in every.columns if c != "_o"]
    key = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.trim("title"))
    first = every.groupBy("symbol", F.sha2(key, 256).alias("_key")).agg(F.min_by(F.struct(*columns), F.struct("_o", "ts", *(C(c).cast("string") for c in columns))).alias("_a"))
    return first.select("_a.*")


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """(symbol, date, sent_score, n_articles, sources, scorer) from articles (symbol, date, source, score, scorer): articles without a score don't count."""
    known = lambda x: F.when(C("score").isNotNull(), x)  # noqa: E731 (a filter instead would make Spark score each article twice)
    sources = F.array_join(F.array_sort(F.collect_set(known(F.nullif("source", F.lit(""))))), ",")
    days = scored.groupBy("symbol", "date").agg(four_places(F.avg("score")).alias("sent_score"), F.count("score").alias("n_articles"), sources.alias("sources"), F.max(known(C("scorer"))).alias("scorer"))
    return days.where("n_articles > 0")


def article_level(n: Column, soft_cap: float = SOFT_CAP) -> Column:
    """A count of articles on [-1, 1] by its logarithm: none is -1, ``soft_cap`` is 1."""
    return F.when(n <= 0, -1.0).otherwise(clip(2 * F.log1p(n.cast("double")) / F.log1p(F.lit(soft_cap)) - 1, -1, 1))


def sentiment_features(daily: DataFrame, rows: int = 5) -> DataFrame:
    """(symbol, date, sent_24h, sent_5d, sent_momentum, sent_n_5d, n_articles) of every day from (symbol, date, sent_score, n_articles): the day's score, the mean
    of the last ``rows`` days, the difference and the level of their articles. Means leave nulls out; momentum is null where a side is."""
    w = by_symbol().rowsBetween(-(rows - 1), 0)
    mean, n = F.avg("sent_score").over(w), F.coalesce(F.sum("n_articles").over(w), F.lit(0))
    return daily.select("symbol", "date", four_places(C("sent_score")).alias("sent_24h"), four_places(mean).alias("sent_5d"), four_places(C("sent_score") - mean).alias("sent_momentum"), four_places(article_level(n)).alias("sent_n_5d"), C("n_articles").cast("long").alias("n_articles"))


def sentiment_factor(symbols: DataFrame, features: DataFrame) -> DataFrame:
    """(symbol, sentiment, last_date) of every symbol: its latest day's score, 0 without a day or a score."""
    last = features.groupBy("symbol").agg(F.max_by("sent_24h", "date").alias("_s"), F.max("date").alias("last_date"))
    return symbols.select("symbol").distinct().join(last, "symbol", "left").select("symbol", F.coalesce("_s", F.lit(0.0)).alias("sentiment"), "last_date")


def sentiment_summary(symbols: DataFrame, articles: DataFrame, daily: DataFrame) -> DataFrame:
    """By symbol: articles read and scored, days, first and last day, and the status of the run; symbols without articles stay."""
    read = articles.groupBy("symbol").agg(F.count(F.lit(1)).alias("articles"), F.count("score").alias("scored"))
    days = daily.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    d = symbols.select("symbol").distinct().join(read, "symbol", "left").join(days, "symbol", "left").fillna(0, ["articles", "scored", "days"])
    return d.withColumn("status", F.when(C("articles") == 0, "no_articles").when(C("days") == 0, "no_scores").otherwise("ok"))


def newest(news: DataFrame, n: int, order: tuple[str, ...] = ("date", "doc_id")) -> DataFrame:
    """The ``n`` newest articles of each symbol, with their place."""
    w = Window.partitionBy("symbol").orderBy(*(F.desc(c) for c in order))
    return news.withColumn("place", F.row_number().over(w)).where(C("place") <= n)
