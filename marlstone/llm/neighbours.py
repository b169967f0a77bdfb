"""Approximate nearest neighbours by query-aware collision counting (operator 5).

Vectors are projected on random lines; each block of the index keeps, per line, its projections in order. A query opens a
window around its own projection on every line and widens all windows step by step (virtual rehashing). A vector that has
fallen into the windows of more than ``NEED`` of the lines is a candidate and its true distance is computed. Widening stops
once there are enough candidates. Blocks answer independently; their answers are merged by query.

Equal vectors are one entry with its smallest ids, so that a vector that very many rows share costs no more than another.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.spool import spool

LINES, NEED, WIDEN = 128, 0.7, 1.3
SHARE, AT_LEAST = 0.04, 200  # candidates of a block at which widening stops: this share of its entries, but so many at least
BLOCK, QUERIES = 16384, 512  # entries of an index block and queries of a chunk


def usable(vector: Column) -> Column:
    """Not null, not empty, finite throughout and not zero."""
    x = vector
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def project(x: np.ndarray, seed: int = 5) -> np.ndarray:
    lines = np.random.default_rng(seed).normal(size=(x.shape[1], LINES))
    return x @ (lines / np.linalg.norm(lines, axis=0))


def search_block(index: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, entries, distances): the k nearest found, and those that tie with the last."""
    n = len(index)
    p, q = np.ascontiguousarray(project(index).T), np.ascontiguousarray(project(queries).T)  # line by line, so that a window is one run of memory
    order = np.argsort(p, axis=1).astype(np.int32)
    lines = np.sort(p, axis=1)
    spread = np.subtract(*np.quantile(lines, [0.75, 0.25], axis=1)).mean() / 1.35 or 1.0
    enough, need = min(n, max(AT_LEAST, math.ceil(SHARE * n), 4 * k)), math.ceil(NEED * LINES)

    @functools.lru_cache(maxsize=16)
    def window(step: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of all queries begin and end; those of step 0 are empty."""
        with np.errstate(over="ignore"):
            width = 0.4 * spread * np.float64(WIDEN) ** (step - 1) if step else 0.0
        ends = [[np.searchsorted(line, x - width, "left"), np.searchsorted(line, x + width, "right" if step else "left")] for line, x in zip(lines, q, strict=True)]
        low, high = np.array(ends).transpose(1, 2, 0)
        return low, high

    def between(i: int, inner: int, outer: int) -> np.ndarray:
        """How often each entry lies in a window of the outer step but not in that of the inner one."""
        (low, high), (new_low, new_high) = ([side[i].tolist() for side in window(step)] for step in (inner, outer))
        ring = [row[a:b] for row, *ends in zip(order, new_low, low, high, new_high, strict=True) for a, b in (ends[:2], ends[2:]) if b > a]
        return np.bincount(np.concatenate(ring), minlength=n) if ring else np.zeros(n, np.int64)

    step = 1
    for i in range(len(queries)):
        # the first step at which enough entries are found, sought from the one at which the query before stopped
        count = between(i, 0, step)
        found = np.flatnonzero(count >= need)
        while len(found) < enough:
            count += between(i, step, step + 1)
            step += 1
            found = np.flatnonzero(count >= need)
        while step > 1:
            count -= between(i, step - 1, step)
            fewer = np.flatnonzero(count >= need)
            if len(fewer) < enough:
                break
            found, step = fewer, step - 1
        d = np.sqrt(((index[found] - queries[i]) ** 2).sum(axis=1))
        if len(found) > k:
            last = np.partition(d, k - 1)[k - 1]
            found, d = found[d <= last], d[d <= last]
        yield i, found, d


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id, score (Euclidean distance in double precision); ties go to the smaller vec_id.

    A query doesn't find its own id. Null ids and vectors that ``usable`` turns away take no part. Vectors of
    different lengths have no distance: each length is searched by itself. Rows that repeat an id and its vector count
    once. With fewer than k candidates all are returned; an empty table gives an empty result.
    """
    good = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    by_vector = Window.partitionBy("x").orderBy("id")
    entries = good.withColumn("_r", F.row_number().over(by_vector)).where(F.col("_r") <= k + 1).groupBy("x").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    entries = spool(entries, "entries")
    asked = queries.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("x"))
    # vectors of each length have an index of their own
    sizes = entries.groupBy(F.size("x").alias("d")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    sizes = spool(sizes.join(asked.groupBy(F.size("x").alias("d")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("chunks")), "d"), "sizes")
    index = entries.withColumn("d", F.size("x")).join(sizes, "d").select("d", F.pmod(F.xxhash64(F.element_at("ids", 1)), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "x", "ids")
    wanted = asked.withColumn("d", F.size("x")).join(sizes, "d").select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), "chunks").alias("chunk"), "x", "query_id")

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            left = left.take(pa.array(np.argsort([v[0] for v in left.column("ids").to_pylist()], kind="stable")))
            ids, names = left.column("ids").to_pylist(), right.column("query_id").to_pylist()
            for i, found, d in search_block(matrix(left.column("x")), matrix(right.column("x")), k + 1):
                for e, s in zip(found.tolist(), d.tolist(), strict=True):
                    for v in ids[e]:
                        if v != names[i]:
                            rows[0].append(names[i])
                            rows[1].append(v)
                            rows[2].append(s)
        return pa.table({"query_id": pa.array(rows[0], pa.int64()), "vec_id": pa.array(rows[1], pa.int64()), "score": pa.array(rows[2], pa.float64())})

    answers = index.groupBy("d", "block", "chunk").cogroup(wanted.groupBy("d", "block", "chunk")).applyInArrow(answer, "query_id long, vec_id long, score double")
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.distinct().withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_of_hundredths(vectors: DataFrame) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by 100, against all rows."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
