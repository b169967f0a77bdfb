"""Labelled rows to learn from, and the split that keeps held-out rows away from learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column, fold: int) -> Column:
    """True where crc32 of the key as text is divisible by ``fold``. A null key is held out."""
    return F.coalesce(F.crc32(key.cast("string")) % fold == 0, F.lit(True))


BROADCAST_LABELS = 1 << 20  # up to so many labels (16 MiB) are broadcast; more are joined by a shuffle


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int | None, fold: int = 5) -> DataFrame:
    """(text, lang if there, y) of at most ``most`` labelled rows outside the held-out fold, chosen by hash of the id; of all of them without ``most``.

    ``most`` bounds what is broadcast and what comes to the driver; without it, ``BROADCAST_LABELS`` bounds what is broadcast. Rows whose label is null or neither 0 nor 1 are left out; of several labels for one
    document the largest counts.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), fold))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .select("doc_id", "y")
    )
    if most is not None:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    few = most is not None or labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    have = [c for c in ("text", "lang") if c in docs.columns]
    return docs.select("doc_id", *have).join(F.broadcast(chosen) if few else chosen, "doc_id").select("doc_id", *have, "y")
