"""The sentiment roll-up and the freshness monitor over files that arrive one by one."""

import datetime as dt
import json

from marlstone.streaming import monitors


def at(day, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def run(spark, tmp_path, name, schema, batches, make, conf=None):
    """Each batch is a file; one file a micro-batch."""
    src = tmp_path / name
    src.mkdir()
    for k, rows in enumerate(batches):
        (src / f"{k:03d}.json").write_text("\n".join(json.dumps(r, default=lambda x: x.isoformat()) for r in rows))
        import os

        os.utime(src / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive
    return [tuple(r) for r in spark.table(name).collect()]


def test_daily_sentiment_counts_articles_once(spark, tmp_path):
    row = lambda s, ts, url, title, score, source="a": {"symbol": s, "ts": ts, "url": url, "title": title, "source": source, "score": score}
    batches = [
        [row("x", at(0, 1), "u1", "T", 1.0), row("x", at(0, 2), "u1", "other title", -1.0), row("x", at(0, 3), None, "Same Title ", 0.0, "b"), row("y", at(0, 3), "u1", "T", 0.5)],
        [row("x", at(1, 1), "", "same title", 0.9), row("x", at(1, 2), "u2", "N", None, "c"), row("x", at(0, 23), "u3", "late but in time", 0.5)],
        [row("z", at(9), "u9", "far", 0.0)],
        [row("z", at(10), "u11", "far", 0.0)],  # late rows are told by the watermark of the batch before
        [row("x", at(0, 5), "u5", "too late", 9.0), row("z", at(12), "u10", "far", 0.0)],
    ]
    got = run(spark, tmp_path, "sentiment", "symbol string, ts timestamp, url string, title string, source string, score double", batches, monitors.daily_sentiment)
    days = {(s, d.day): (n, score, sources) for s, d, n, score, sources in got if s != "z"}
    assert days == {("x", 1): (3, 0.5, ["a", "b"]), ("y", 1): (1, 0.5, ["a"]), ("x", 2): (0, None, ["c"])}


def test_monitor_tells_of_silence_once(spark, tmp_path):
    e = lambda s, h: {"source": s, "ts": at(0, 0) + dt.timedelta(hours=h)}
    batches = [[e("a", 0), e("b", 0)], [e("a", 1), e("a", 2)], [e("a", 4)], [e("a", 5), e("b", 5)], [e("a", 9), e("a", 9)], [e("a", 10)]]
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    got = run(spark, tmp_path, "fresh", "source string, ts timestamp", batches, lambda d: monitors.freshness_monitor(d, "3 hours"), conf)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = sorted((s, last.hour, state) for s, last, state in got)
    assert ("b", 0, "stale") in told and ("b", 5, "stale") in told
    assert len([t for t in told if t[0] == "b"]) == 2  # each silence once
    assert all(t[1] != 4 for t in told if t[0] == "a")  # never silent for three hours before 5
