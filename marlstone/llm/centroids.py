"""Centroid clustering with an equal-average, equal-variance search (operator 11).

Vectors are turned into integers and stay partitioned; the few centroids go to every task. A task sorts the centroids by the sum
of their components. A vector starts at the place of its own sum in that order and scans outward in both directions: with n
components, (sum x - sum c)^2 / n is a lower bound of the squared distance that only grows on the way out, so a side ends at the
first centroid beyond the best distance so far; where the deviations from the means differ too, (|dev x| - |dev c|)^2 adds to the bound
and rejects single centroids. The survivors' distances are computed in integers, so the result is that of an exhaustive search.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.spool import spool, unspool

CLUSTERS, ROUNDS, LENGTH, SCALE, SEED = 8, 10, 64, 1024, 3
WIDEST = 1e100  # larger components have no squares in double precision, which the bounds need
LIMB, LIMBS = 32, 7  # exact sums travel as so many parts of so many bits
ROWS = 4096  # vectors that are scanned together


def usable(vector: Column, length: int) -> Column:
    """Exactly ``length`` components, none null, not finite or beyond ``WIDEST`` (no float is)."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= WIDEST))
    return F.coalesce((F.size(vector) == length) & fine, F.lit(False))


def narrow(length: int) -> int:
    """Below this size of all components a squared distance fits in 64 bits."""
    return 1 << ((62 - math.ceil(math.log2(max(length, 2)))) // 2 - 1)


def as_integers(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as int64, or as Python integers where squares could outgrow it."""
    rows = np.floor(rows * scale)
    if not len(rows) or np.abs(rows).max() < narrow(rows.shape[1]):
        return rows.astype(np.int64)
    return np.array([[int(v) for v in r] for r in rows.tolist()], dtype=object)


def common(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids in one integer type that holds their distances."""
    big = x.dtype == object or max((abs(v) for c in centroids for v in c), default=0) >= narrow(x.shape[1])
    return (x.astype(object), np.array(centroids, dtype=object)) if big else (x, np.array(centroids, np.int64))


def search(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), its squared distance, and how many distances were computed.

    Bounds are floating point with a margin far above their rounding; a centroid is rejected only beyond the best distance, never at it.
    """
    n, k, size = len(x), len(c), x.shape[1]
    sums = c.sum(axis=1)
    order = np.array(sorted(range(k), key=lambda j: (sums[j], j)))
    c_sum = sums[order].astype(np.float64)
    c_dev = np.sqrt(np.maximum((c.astype(np.float64) ** 2).sum(axis=1)[order] - c_sum**2 / size, 0))
    x_sum = x.sum(axis=1).astype(np.float64)
    x_dev = np.sqrt(np.maximum((x.astype(np.float64) ** 2).sum(axis=1) - x_sum**2 / size, 0))
    slack = 1e-6 * (np.abs(x_sum).max(initial=0) + np.abs(c_sum).max() + x_dev.max(initial=0) + c_dev.max()) + 1e-3  # of a difference of sums or deviations
    right = np.searchsorted(c_sum, x_sum)
    left = right - 1
    number, best = np.full(n, k, np.int64), np.full(n, np.inf)
    exact = np.zeros(n, x.dtype)
    live, done = np.arange(n), 0
    while len(live):
        s = x_sum[live]
        gap_l = np.where(left[live] >= 0, s - c_sum[np.maximum(left[live], 0)], np.inf)
        gap_r = np.where(right[live] < k, c_sum[np.minimum(right[live], k - 1)] - s, np.inf)
        use_l = gap_l <= gap_r
        gap = np.maximum(np.where(use_l, gap_l, gap_r) - slack, 0)
        go = gap * gap / size <= best[live]  # the nearer side is beyond the best: so is all that is further out
        live, use_l, gap = live[go], use_l[go], gap[go]
        at = np.where(use_l, left[live], right[live])
        left[live[use_l]] -= 1
        right[live[~use_l]] += 1
        dev = np.maximum(np.abs(x_dev[live] - c_dev[at]) - slack, 0)
        keep = gap * gap / size + dev * dev <= best[live]
        rows, cand = live[keep], order[at[keep]]
        done += len(rows)
        diff = x[rows] - c[cand]
        d = (diff * diff).sum(axis=1)
        first = number[rows] == k
        nearer = first | (d < exact[rows]) | ((d == exact[rows]) & (cand < number[rows]))
        rows = rows[nearer]
        exact[rows], number[rows] = d[nearer], cand[nearer]
        best[rows] = d[nearer].astype(np.float64) * (1 + 1e-9) + 1e-6
    return number, exact, done


def limbs(values: np.ndarray) -> np.ndarray:
    """Integers of any size as two's complement parts, the last one signed; such parts can be summed apart."""
    out = np.zeros((len(values), LIMBS), np.int64)
    if values.dtype != object:
        for p in range(2):
            out[:, p] = values & ((1 << LIMB) - 1) if p == 0 else values >> LIMB
        return out
    for i, v in enumerate(values.tolist()):
        for p in range(LIMBS - 1):
            out[i, p] = v & ((1 << LIMB) - 1)
            v >>= LIMB
        out[i, LIMBS - 1] = v
    return out


def whole(parts: list[int]) -> int:
    return sum(v << (LIMB * p) for p, v in enumerate(parts))


def blocks(batch: pa.RecordBatch, column: int, length: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, as_integers(part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length), scale)


def partial_sums(vectors: DataFrame, centroids: list[list[int]], length: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and exact component sums of each cluster. A task hands on one row per cluster and component, whatever it reads."""
    k = len(centroids)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, length), dtype=object), np.zeros(k, np.int64)
        for batch in it:
            for _, x in blocks(batch, 0, length, scale):
                x, c = common(x, centroids)
                number, _, _ = search(x, c)
                order = np.argsort(number, kind="stable")
                present, first = np.unique(number[order], return_index=True)
                total[present] += np.add.reduceat(x[order], first, axis=0).astype(object)
                count += np.bincount(number, minlength=k)
        some = np.flatnonzero(count)
        if len(some):
            parts = limbs(total[some].ravel())
            cols = [np.repeat(some, length).astype(np.int32), np.tile(np.arange(length, dtype=np.int32), len(some)), np.repeat(count[some], length), *parts.T]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in cols], names=["cluster", "place", "n", *(f"p{p}" for p in range(LIMBS))])

    schema = "cluster int, place int, n long, " + ", ".join(f"p{p} long" for p in range(LIMBS))
    rows = vectors.select("v").mapInArrow(batches, schema).groupBy("cluster", "place").agg(F.sum("n").alias("n"), *(F.sum(f"p{p}").alias(f"p{p}") for p in range(LIMBS)))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in rows.collect():  # clusters times components
        found.setdefault(r["cluster"], (r["n"], [0] * length))[1][r["place"]] = whole(list(r)[3:])
    return found


def starting(vectors: DataFrame, clusters: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of ``seed:id``; vectors without an id come last, and vectors of one id by their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [[math.floor(v * scale) for v in r["v"]] for r in vectors.orderBy(F.asc_nulls_last(h), F.col("v")).limit(clusters).collect()]


def assigned(vectors: DataFrame, centroids: list[list[int]], length: int, scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of each vector; a distance beyond 64 bits is null in ``distance`` and whole in ``exact``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, x in blocks(batch, 1, length, scale):
                number, exact, _ = search(*common(x, centroids))
                d = exact.tolist()
                cols = [part.column(0), pa.array(number.astype(np.int32)), pa.array([v if v < 1 << 63 else None for v in d], pa.int64()), pa.array([None if v < 1 << 63 else str(v) for v in d], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cluster", "distance", "exact"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "v").mapInArrow(batches, f"vec_id {kind}, cluster int, distance long, exact string")


def cluster_vectors(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: int = SEED, vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of ``length`` finite components.

    Components become floor(scale * x). Repeated rows each count and each have their row; ties go to the smaller centroid number. Fewer
    vectors than ``clusters`` give as many centroids as there are; an empty table gives no rows. Rows without an id take part, but start
    a centroid only after all others. Distances and inertias that 64 bits don't hold are null. Other columns are left out.
    """
    column = F.col(f"`{vector}`")
    vectors = spool(table.where(usable(column, length)).select(F.col("`vec_id`").alias("vec_id"), column.alias("v")), "vectors")
    centroids = starting(vectors, clusters, seed, scale)
    spark = table.sparkSession
    if centroids:
        for _ in range(rounds):
            found = partial_sums(vectors, centroids, length, scale)
            after = [[s // found[j][0] for s in found[j][1]] if j in found else c for j, c in enumerate(centroids)]
            if after == centroids:
                break  # further rounds would change nothing
            centroids = after
    last = spool(assigned(vectors, centroids, length, scale), "assigned") if centroids else spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, exact string")
    unspool(vectors)
    parts = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count("exact").alias("wide")).collect()  # clusters at most
    inertia = {r["cluster"]: None if r["wide"] or r["d"] is None else int(r["d"]) for r in parts}
    total = None if None in inertia.values() else sum(inertia.values())
    fits = lambda v: None if v is None or v >= 1 << 63 else v
    digest = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(centroids)}
    facts = spark.createDataFrame([(j, fits(v), fits(total), digest[j]) for j, v in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.drop("exact").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
