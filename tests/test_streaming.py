"""Streams give what the batch operators give."""

from marlstone.operators.align import candles
from marlstone.sources.adapters import table
from marlstone.streaming.jobs import latest_version, stream_alerts, stream_candles, stream_trailing_stop, upsert_sink

SF = "/root/testdata/sf0.001"


def test_candles_of_a_stream_match_the_batch(spark, tmp_path):
    ticks = table(spark, SF, "ticks")
    ticks.repartition(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = stream_candles(src).writeStream.outputMode("append").format("memory").queryName("candles").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["symbol"], r["start"].isoformat()[:16]): (r["open"], r["close"], r["n"]) for r in spark.table("candles").collect()}
    want = {(r["symbol"], r["start"].isoformat()[:16]): (r["open"], r["close"], r["n"]) for r in candles(ticks).collect()}
    assert got and set(got) <= set(want) and all(want[k] == v for k, v in got.items())
    assert len(want) - len(got) <= 5 * 3  # windows that the watermark hasn't passed


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_a_stop_is_hit_only_after_the_high_that_sets_it(spark, tmp_path):
    rows = [("up", 1, 80.0), ("up", 2, 100.0), ("down", 1, 100.0), ("down", 2, 89.0), ("flat", 1, 50.0)]
    spark.createDataFrame(rows, "symbol string, ts long, price double").coalesce(1).write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("symbol string, ts long, price double").parquet(str(tmp_path / "ticks"))
    run(stream_trailing_stop(ticks), "stops", "update")
    assert {r["symbol"]: (r["high"], round(r["stop"], 9), r["hit"]) for r in spark.table("stops").collect()} == {"up": (100.0, 90.0, False), "down": (100.0, 90.0, True), "flat": (50.0, 45.0, False)}


def test_an_alert_fires_once(spark, tmp_path):
    for k, price in enumerate((1.0, 9.0, 12.0)):
        spark.createDataFrame([("a", k, price)], "symbol string, ts long, price double").coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    alerts = spark.createDataFrame([(1, "a", 8.0, "above"), (2, "a", 0.5, "below")], "alert_id long, symbol string, threshold double, direction string")
    ticks = spark.readStream.option("maxFilesPerTrigger", 1).schema("symbol string, ts long, price double").parquet(str(tmp_path / "ticks"))
    run(stream_alerts(ticks, alerts), "fired", "append")
    assert [r["alert_id"] for r in spark.table("fired").collect()] == [1]


def test_an_upsert_sink_keeps_the_newest_row_and_survives_a_repeat(spark, tmp_path):
    path = str(tmp_path / "table")
    write = upsert_sink(path, ["k"], "at")
    frame = lambda rows: spark.createDataFrame(rows, "k long, at long, v string")
    assert latest_version(spark, path) is None
    write(frame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]), 0)
    write(frame([(2, 5, "d"), (3, 1, "e")]), 1)
    frame([(9, 9, "half")]).write.parquet(f"{path}/v2")  # a crash between the version and its entry
    write(frame([(2, 5, "d"), (3, 1, "e")]), 1)
    write(frame([(3, 2, "f")]), 2)
    got = {r["k"]: r["v"] for r in spark.read.parquet(f"{path}/v{latest_version(spark, path)}").collect()}
    assert got == {1: "b", 2: "d", 3: "f"}
