"""Centroid clustering against an exhaustive search in plain Python."""

import hashlib
import math
import random

import numpy as np

from marlstone.llm import centroids
from marlstone.llm.centroids import cluster_vectors

SCHEMA = "vec_id long, embedding array<float>, cluster string, `a.b` int"


def brute(rows, clusters, rounds, length, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in first[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        groups = [[] for _ in c]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else w for g, w in zip(groups, c, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    fits = lambda v: v if v < 1 << 63 else None
    inside = {j: sum(d for _, d, k in found if k == j) for j in range(len(c))}
    return sorted(((-1 if i is None else i), j, fits(d), fits(inside[j]), fits(total), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found)


def result(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def f32(v):
    return [None if x is None else float(np.float32(x)) for x in v]


def test_clusters_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, f32([rng.gauss(k % 5, 1) for _ in range(6)])) for k in range(150)]
    rows += [(200 + k, f32([0.5] * 6)) for k in range(60)]  # one vector that very many rows share
    rows += [(7, rows[7][1]), (None, f32([1.0] * 6)), (None, f32([1.0] * 6)), (300, None), (301, []), (302, f32([1, 2])), (303, f32([1, None, 1, 1, 1, 1])), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (306, f32([-0.0] * 6))]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    assert result(cluster_vectors(df, clusters=8, rounds=10, length=6)) == brute(rows, 8, 10, 6, 1024)
    assert result(cluster_vectors(df, clusters=3, rounds=2, length=6)) == brute(rows, 3, 2, 6, 1024)


def test_ties_few_vectors_and_empty_table(spark):
    rows = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    assert result(cluster_vectors(df, clusters=2, rounds=1, length=2)) == brute(rows, 2, 1, 2, 1024)
    assert result(cluster_vectors(df, clusters=8, length=2)) == brute(rows, 8, 10, 2, 1024)
    empty = cluster_vectors(df.where("vec_id > 9"), length=2)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_64_bits(spark):
    rows = [(k, f32([1e30 * (k % 3), -3e38 if k == 4 else k, 0.1])) for k in range(12)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    assert result(cluster_vectors(df, clusters=3, rounds=3, length=3)) == brute(rows, 3, 3, 3, 1024)


def test_bounds_reject_without_changing_the_result():
    rng = np.random.default_rng(1)
    c = np.concatenate([rng.integers(-4000, 4000, (20, 1)) + rng.integers(-30, 30, (20, 64)), rng.integers(-1500, 1500, (20, 64))])
    x = c[rng.integers(0, 40, 3000)] + rng.integers(-100, 100, (3000, 64))
    number, exact, done = centroids.search(x, c)
    d = ((x[:, None, :] - c[None]) ** 2).sum(-1)
    assert (number == d.argmin(1)).all() and (exact == d.min(1)).all()
    assert done < 0.4 * d.size  # the inequalities leave out most distances
    assert centroids.whole(centroids.limbs(np.array([-(1 << 150) + 7], dtype=object))[0].tolist()) == -(1 << 150) + 7
