"""Streams over articles and events: a daily roll-up of sentiment without repeats, and a monitor that tells of sources that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

C = F.col


def article_key() -> Column:
    """What tells articles apart: the url, or the title where there is none."""
    url = F.trim(F.coalesce("url", F.lit("")))
    return F.when(url != "", url).otherwise(F.lower(F.trim(F.coalesce("title", F.lit("")))))


def daily_sentiment(articles: DataFrame, late: str = "2 days") -> DataFrame:
    """(symbol, day, n, score, sources) from a stream (symbol, ts, url, title, source, score): an article counts once however often it comes
    within ``late``; rows later than that are dropped. A day is told once it can't change any more."""
    d = articles.withWatermark("ts", late).withColumn("_key", F.concat_ws("|", C("symbol").cast("string"), article_key())).dropDuplicatesWithinWatermark(["_key"])
    days = d.groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.count("score").alias("n"), F.avg("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return days.select("symbol", F.to_date("w.start").alias("day"), "n", "score", "sources")


class Freshness(StatefulProcessor):
    """The last event of a source and whether the silence after it has been told; a timer fires where none follows for ``after_ms`` of event time."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, told boolean")

    def _stale(self, key, moments: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"source": [key[0]] * len(moments), "last": pd.to_datetime(moments, unit="ms"), "state": ["stale"] * len(moments)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, told = self.last.get() if self.last.exists() else (None, True)
        silences = []
        for at in sorted(int(t.value // 1_000_000) for r in rows for t in r["ts"]):
            if last is None or at > last:
                if not told and at - last > self.after_ms:  # the timer had no batch to fire in
                    silences.append(last)
                last, told = at, False
        if not told:
            self.last.update((last, told))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(last + self.after_ms)
        return iter([self._stale(key, silences)] if silences else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, told = self.last.get()
        self.last.update((last, True))
        return iter([] if told else [self._stale(key, [last])])

    def close(self) -> None:
        pass


def freshness_monitor(events: DataFrame, after: str = "1 hour") -> DataFrame:
    """(source, last, state): one row each time a source of the stream (source, ts) has been silent for ``after`` beyond its last event, by the clock
    of the stream itself. A source that comes back is watched again."""
    ms = int(pd.Timedelta(after).value // 1_000_000)
    return events.select("source", "ts").withWatermark("ts", "0 seconds").groupBy("source").transformWithStateInPandas(Freshness(ms), "source string, last timestamp, state string", "Append", "eventTime")
