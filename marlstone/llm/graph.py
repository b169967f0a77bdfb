"""Connected components of an edge table by alternating large-star and small-star steps (distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.spool import reads, spool, unspool


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other node only, which itself hangs on none: then each star is a component."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (large) or smaller-or-equal (small) neighbours on its smallest neighbour.

    Only a minimum is aggregated by node and joined back, so a node with very many neighbours needs no list of them.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
    if large:
        out = hung.where(F.col("u") > F.col("w")).select("u", "v")
    else:
        out = hung.select("u", "v").unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable. Nulls and loops are left out; an empty table gives an empty one."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = spool(e, "edges")
    for _ in range(most_rounds):
        if _settled(e):
            break
        last, e = e, spool(_star(_star(e, large=True), large=False), "edges")
        unspool(last)
    else:
        raise RuntimeError("components did not settle")
    return reads(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), e)
