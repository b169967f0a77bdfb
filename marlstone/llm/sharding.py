"""Placement of rows by a hierarchical weighted hash tree (operator 10).

A row goes down the tree region > rack > shard. At each level every child draws ``-ln(u) / weight`` where ``u`` in (0, 1) is a
hash of the row's key and the child's name; the smallest draw wins. A child's draw depends on nothing but the key, its name
and its weight (the sum of the weights below it), so a change of weights moves rows only into or out of the children whose
weights changed. A shard added in a region of its own takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.spool import checkpoint


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. ``shard`` is set on leaves only; an inner node weighs what its children weigh."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> Node:
    """``shards`` leaves of weight 1 dealt over regions and racks in blocks."""
    per_region = -(-shards // regions)
    per_rack = -(-per_region // racks)
    tops = []
    for r in range(0, shards, per_region):
        region = range(r, min(shards, r + per_region))
        name = f"g{r // per_region}"
        rack = [region[k : k + per_rack] for k in range(0, len(region), per_rack)]
        tops.append(Node(name, tuple(Node(f"{name}.k{i}", tuple(Node(f"{name}.k{i}.s{s}", shard=s) for s in part)) for i, part in enumerate(rack))))
    return Node("root", tuple(tops))


def grown_tree(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a new region of its own."""
    name = f"g{len(tree.children)}"
    leaf = Node(f"{name}.k0.s{shard}", shard=shard, own_weight=weight)
    return Node("root", (*tree.children, Node(name, (Node(f"{name}.k0", (leaf,)),))))


def draw(key: Column, node: Node) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(unit) / F.lit(float(node.weight))


def place(key: Column, node: Node) -> Column:
    """The shard for a key, as a column expression. Children of weight 0 get nothing."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"nothing below {node.name} has a weight")
    if len(live) == 1:
        return place(key, live[0])
    draws = [draw(key, c) for c in live]
    best = F.least(*draws)
    return reduce(lambda rest, c: F.when(c[0] == best, place(key, c[1])).otherwise(rest), list(zip(draws, live, strict=True))[:-1][::-1], place(key, live[-1]))


def number_within(rows: DataFrame, group: str, out: str) -> DataFrame:
    """Gapless numbers from 0 within each group, without bringing a group into one task.

    Rows are checkpointed, so that each row keeps its partition; a partition's share of a group starts where the shares of
    the partitions before it end.
    """
    held = checkpoint(rows).withColumn("_at", F.monotonically_increasing_id())
    held = held.withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n")).select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_part").orderBy("_at")
    return held.withColumn("_rank", F.row_number().over(inside)).join(starts, [group, "_part"]).withColumn(out, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_at", "_part", "_rank", "_start")


def shard_documents(docs: DataFrame, shards: int = 8, tree: Node | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the key and the tree decide. Null text is empty (size 1, crc32 0); null keys are a key like any other;
    repeated rows go to one shard and get slots of their own; an empty table gives an empty table; other columns are left out.
    """
    tree = tree or even_tree(shards)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    k = F.col(key)
    rows = docs.select(
        k.alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(k, tree).cast("int").alias("shard"),
        place(k, grown_tree(tree, shards)).cast("int").alias("grown_shard"),
    )
    return number_within(rows, "shard", "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
