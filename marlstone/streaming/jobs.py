"""Incremental twins of batch operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.upsert import replace_rows, update_columns


def stream_candles(ticks: DataFrame, minutes: int = 15, late: str = "30 minutes") -> DataFrame:
    """Candles of a tick stream (symbol, ts, price, event_id); a window is given out once the watermark has passed it."""
    at = F.struct("ts", "event_id")
    t = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = t.groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def stream_alerts(ticks: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each alert (symbol, alert_id, threshold, direction) fires once, on the first tick that reaches its threshold."""
    up = (F.col("direction") == "above") & (F.col("price") >= F.col("threshold"))
    down = (F.col("direction") == "below") & (F.col("price") <= F.col("threshold"))
    hits = ticks.join(alerts, "symbol").where(up | down).select("alert_id", "symbol", F.col("ts").cast("timestamp").alias("ts"), "price")

    def once(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        if not state.exists:
            state.update((True,))
            yield rows.sort_values(["ts", "price"]).head(1)[["alert_id", "symbol", "ts", "price"]]

    return hits.groupBy("alert_id").applyInPandasWithState(once, "alert_id long, symbol string, ts timestamp, price double", "fired boolean", "append", GroupStateTimeout.NoTimeout)


def stream_trailing_stop(ticks: DataFrame, share: float = 0.1) -> DataFrame:
    """The stop of each symbol only ever rises: its highest price so far less ``share``. One row by symbol and batch.

    Ticks (symbol, ts, price) are walked in order of time within a batch, of equal times the lower price first; a tick hits if
    it is at or below the stop that the ticks before it have set.
    """

    def ratchet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price = pd.concat(list(batches)).sort_values(["ts", "price"], kind="stable")["price"].astype(float)
        start = state.get[0] if state.exists else float("-inf")
        highs = pd.concat([pd.Series([start]), price]).cummax().to_numpy()
        state.update((float(highs[-1]),))
        hit = bool((price.to_numpy() <= highs[:-1] * (1 - share)).any())
        yield pd.DataFrame({"symbol": [key[0]], "high": [highs[-1]], "stop": [highs[-1] * (1 - share)], "hit": [hit]})

    return ticks.groupBy("symbol").applyInPandasWithState(ratchet, "symbol string, high double, stop double, hit boolean", "high double", "update", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, keys: list[str], order: str, whole_rows: bool = True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into a Parquet table; of a batch's rows with equal keys the one with the largest ``order`` counts.

    Every merge is a new folder ``path/v<batch>``; a row is then appended to ``path/versions``. A crash in between leaves the
    version before as it was, and the batch comes again; a batch that is already there changes nothing.
    """
    merge = replace_rows if whole_rows else update_columns

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        version = latest_version(spark, path)
        if version is not None and version >= number:
            return
        out = merge(spark.read.parquet(f"{path}/v{version}"), newest, keys) if version is not None else newest
        out.write.mode("overwrite").parquet(f"{path}/v{number}")
        spark.range(number, number + 1).coalesce(1).write.mode("append").parquet(f"{path}/versions")

    return write


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The number of the table's latest whole version; None before the first one."""
    try:
        versions = spark.read.parquet(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return versions.agg(F.max("id")).first()[0]
