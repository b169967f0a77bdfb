"""Exponentially weighted means without a Python step per row and without a join.

Rows of a series are numbered and cut into blocks. Within a block the recurrence S = q S + x is a window sum of x q^-k. What
the blocks before carry on is folded from the ends of the latest of them: a block so far back that its weight is below 1e-18
adds nothing in double precision, so their number has a bound. All windows go by the series, after one shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


def ewm_mean(df: DataFrame, value: str, out: str, alpha: float, adjust: bool, least: int = 1, key: str = "symbol", order: str = "date") -> DataFrame:
    """Adds ``out``. Leading nulls of ``value`` are skipped (their rows get null); nulls further on are not allowed."""
    q = 1.0 - alpha
    some = F.col(value).isNotNull()
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("_n", F.sum(some.cast("long")).over(w))
    if q <= 0.0:
        return d.withColumn(out, F.when(F.col("_n") >= least, F.col(value))).drop("_n")
    d = d.withColumn("_b", F.when(F.col("_n") > 0, F.floor((F.col("_n") - 1) / BLOCK)))
    inside = Window.partitionBy(key, "_b").orderBy(order)
    k = (F.col("_n") - 1) % BLOCK
    part = F.sum(F.col(value) * F.pow(F.lit(q), -k)).over(inside.rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(q), k)
    d = d.withColumn("_s", F.when(some, part))
    far = math.ceil(math.log(1e-18) / (BLOCK * math.log(q)))
    before = Window.partitionBy(key).orderBy("_b").rangeBetween(-far, -1)
    ends = F.collect_list(F.when(k == BLOCK - 1, F.col("_s"))).over(before)
    d = d.withColumn("_carry", F.aggregate(ends, F.lit(0.0), lambda s, x: s * (q**BLOCK) + x))
    total = F.col("_s") + F.col("_carry") * F.pow(F.lit(q), k + 1)
    first = F.first(F.col(value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    mean = alpha * total / (1 - F.pow(F.lit(q), F.col("_n"))) if adjust else alpha * total + F.pow(F.lit(q), F.col("_n")) * first
    return d.withColumn(out, F.when(F.col("_n") >= least, mean)).drop("_n", "_b", "_s", "_carry")


def ewm_std(df: DataFrame, value: str, out: str, span: int, least: int, key: str = "symbol", order: str = "date") -> DataFrame:
    """Adds the exponentially weighted standard deviation, adjusted and without bias as in pandas; nulls as in ``ewm_mean``.

    With weights of q^age the variance is (E[x^2] - E[x]^2) / (1 - sum w^2 / (sum w)^2). Values are shifted by the key's first one
    so that little is lost in the difference.
    """
    alpha = 2.0 / (span + 1)
    q = 1.0 - alpha
    shift = F.first(F.col(value), ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("_x", F.col(value) - shift).withColumn("_xx", F.col("_x") * F.col("_x"))
    d = d.withColumn("_k", F.count("_x").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    d = ewm_mean(ewm_mean(d, "_x", "_m1", alpha, True, least, key, order), "_xx", "_m2", alpha, True, least, key, order)
    qk = F.pow(F.lit(q), F.col("_k"))
    squares = ((1 - q) / (1 + q)) * (1 + qk) / (1 - qk)
    var = F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0)) / (1 - squares)
    return d.withColumn(out, F.when((F.col("_k") >= F.greatest(F.lit(least), F.lit(2))) & F.col("_m2").isNotNull(), F.sqrt(var))).drop("_x", "_xx", "_k", "_m1", "_m2")
