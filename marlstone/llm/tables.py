"""Small helpers on tables that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000  # a key is hot from this part of all rows on, so that there are at most so many hot keys
SALTS = 64  # tasks that share a hot key's rows
FAN_IN, LEVELS = 64, 3  # tables that one group adds up, and levels of such sums before the last
PART = "part int, task int, counts binary"


def fresh(taken: list[str], name: str) -> str:
    """A column name close to ``name`` that isn't among ``taken``, in whatever case."""
    have = {c.lower() for c in taken}
    out = f"__{name}"
    while out.lower() in have:
        out = "_" + out
    return out


def join_split(rows: DataFrame, table: DataFrame, on: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which holds each key once and says in ``count`` how many rows have it.

    Keys with more than a thousandth of all counted rows, a thousand keys at most, are broadcast as hot ones; their rows are
    dealt over ``SALTS`` copies of the table's row. The name ``salt`` must be free.
    """
    bound = F.lit((table.agg(F.sum(count)).first()[0] or 0) / HOT_SHARE)
    hot = F.broadcast(table.where(F.col(count) > bound).select(*on, F.lit(True).alias("hot")))
    dealt = rows.join(hot, on, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    copies = table.withColumn("salt", F.explode(F.when(F.col(count) > bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*on, "salt"]).drop("salt")


def table_parts(table: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A task's table of whole numbers as rows of ``PART``, one for each of its parts that holds anything."""
    task = TaskContext.get().partitionId()
    for k, p in enumerate(np.split(table.ravel(), parts)):
        if p.any():
            packed = pa.compress(p.astype(np.int64).tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([packed], pa.binary())], names=["part", "task", "counts"])


def summed(rows: DataFrame, parts: int, size: int) -> np.ndarray:
    """The sum of all tables of ``size`` numbers behind rows of ``PART``, in 64 bits.

    Tables are added up by 64 tasks at a time, level by level, so that no group holds a row for each of many tasks; the last sum is of one row for each
    262,144 tasks. Only the one table comes back.
    """
    each = size // parts

    def add(some: pa.Table) -> pa.Table:
        total = np.zeros(each, np.int64)
        for c in some.column("counts"):
            total += np.frombuffer(pa.decompress(c.as_py(), each * 8, "zstd", asbytes=True), np.int64)
        return pa.table({"part": some.column("part").slice(0, 1).combine_chunks(), "task": some.column("task").slice(0, 1).combine_chunks(), "counts": pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())})

    for _ in range(LEVELS):
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("part", "task").applyInArrow(add, PART)
    got = rows.groupBy("part").applyInArrow(add, PART).toArrow()
    out = np.zeros((parts, each), np.int64)
    for part, counts in zip(got.column("part").to_pylist(), got.column("counts"), strict=True):
        out[part] = np.frombuffer(pa.decompress(counts.as_py(), each * 8, "zstd", asbytes=True), np.int64)
    return out
