"""Benchmark decontamination: rare seeds, then local alignment (operator 3).

The word trigrams of the benchmark are counted over all documents; of each item the rarer part serves as seeds. A document
meets an item where at least two different seeds of it stand on nearby diagonals. The words around them, a passage, are joined to the item and
aligned by Smith-Waterman over words, which scores edited copies too.

The benchmark is worked on in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast has a bound; a larger one takes
more passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.spool import spool
from marlstone.llm.tables import fresh
from marlstone.llm.textbytes import combine, lower, slices, span_hash, words
from marlstone.llm.workers import alone

SEED, RARER, LEAST_SEEDS = 3, 2 / 3, 2
BLOCK_WORDS = 1 << 20  # a block's seeds and postings are some 32 MiB
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5  # of the score of the whole item


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, off)
    return span_hash(lower(data), starts, ends), first


def seeds_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each trigram, and whether it lies within one text."""
    grams = combine(h, SEED)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return grams, doc[: len(grams)] == doc[SEED - 1 :] if len(grams) else np.zeros(0, bool)


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, seeds): hashes of the words and of the trigrams in order. Items of fewer than three words can't be told from chance and have none."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(it):
            for part, data, off in slices(batch):
                h, first = word_hashes(data, off)
                ws = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([(w >> np.uint64(32)).astype(np.uint32).view(np.int32) for w in ws], pa.list_(pa.int32())), pa.array([combine(w, SEED).view(np.int64) for w in ws], pa.list_(pa.int64()))], names=["item_id", "words", "seeds"]
                )

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(batches, "item_id long, words array<int>, seeds array<long>")


def count_seeds(docs: DataFrame, seeds: np.ndarray) -> DataFrame:
    """(seed, n): places of each benchmark trigram in all documents, summed in the tasks first."""
    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        probe = Probe(known)
        total = np.zeros(len(known), np.int64)
        for batch in alone(it):
            for _, data, off in slices(batch):
                grams, inside = seeds_of(*word_hashes(data, off))
                _, which = probe.find(grams, inside)
                total += np.bincount(which, minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], names=["seed", "n"])

    return docs.select("text").mapInArrow(batches, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


class Probe:
    """Membership in a sorted array of hashes; a bitmap turns most others away before the search."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.map = np.zeros(1 << 22, bool)
        self.map[known >> np.uint64(42)] = True

    def find(self, grams: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.map[grams >> np.uint64(42)] & inside)
        which = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
        ok = self.known[which] == grams[at]
        return at[ok], which[ok]


def passages(docs: DataFrame, seeds: np.ndarray, first: np.ndarray, items: np.ndarray, places: np.ndarray, lengths: dict[int, int], needed: dict[int, int]) -> DataFrame:
    """(doc_id, item_id, start, passage): word hashes around each cluster of an item's seeds. ``first``, ``items``, ``places``: postings by seed."""
    sent = docs.sparkSession.sparkContext.broadcast((seeds, first, items, places, lengths, needed))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, items, places, lengths, needed = sent.value
        probe = Probe(known)
        for batch in alone(it):
            for part, data, off in slices(batch):
                h, of_doc = word_hashes(data, off)
                at, which = probe.find(*seeds_of(h, of_doc))
                if not len(at):
                    continue
                count = first[which + 1] - first[which]
                post = np.arange(int(count.sum())) + np.repeat(first[which] - (np.cumsum(count) - count), count)
                place, seed = np.repeat(at, count), np.repeat(which, count)
                item, doc = items[post], np.searchsorted(of_doc, place, side="right") - 1
                diagonal = place - places[post]
                order = np.lexsort((diagonal, item, doc))
                item, doc, diagonal, seed = item[order], doc[order], diagonal[order], seed[order]
                length = np.array([lengths[i] for i in item.tolist()])
                new = np.ones(len(item), bool)
                new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (diagonal[1:] - diagonal[:-1] > length[1:] // 2)
                begins = np.flatnonzero(new)
                ids, rows = part.column(0), ([], [], [], [])
                for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(item)], strict=True):
                    i = int(item[a])
                    if b - a < needed[i] or len(np.unique(seed[a:b])) < needed[i]:
                        continue
                    d, size = int(doc[a]), lengths[i]
                    low = max(int(of_doc[d]), int(diagonal[a]) - size // 2)
                    high = min(int(of_doc[d + 1]), int(diagonal[b - 1]) + size + size // 2 + 1)
                    for column, value in zip(rows, (ids[d].as_py(), i, low - int(of_doc[d]), (h[low:high] >> np.uint64(32)).astype(np.uint32).view(np.int32)), strict=True):
                        column.append(value)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.list_(pa.int32()))], names=["doc_id", "item_id", "start", "passage"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, item_id long, start long, passage array<int>")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of word sequences, and the passage place behind its end. A row of the table at a time: gaps along the row are a running maximum."""
    n = len(passage)
    slope = np.arange(n + 1) * -GAP
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        step = np.zeros(n + 1, np.int64)
        step[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def aligned(pairs: DataFrame, threshold: float) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(it):
            rows = ([], [], [], [], [])
            for k in range(batch.num_rows):
                item, passage = (batch.column(c)[k].values.to_numpy() for c in (4, 3))
                best, end = align(item, passage)
                if best >= threshold * MATCH * len(item):
                    back, _ = align(item[::-1], passage[:end][::-1])
                    _, length = align(item[::-1], passage[:end][::-1])
                    start = batch.column(2)[k].as_py()
                    for column, value in zip(rows, (batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), max(best, back) / (MATCH * len(item)), start + end - length, start + end), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return pairs.select("doc_id", "item_id", "start", "passage", "words").mapInArrow(batches, "doc_id long, item_id long, score double, first_word long, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it holds, with the best alignment: score (share of the item's full score), first_word and end_word in the document.

    Null and empty texts hold nothing; null ids of items or documents take no part. Items that repeat an id with another text are searched one by one; the best alignment counts for their id.
    Of equal scores the earliest passage counts. No document or no item: no row.
    """
    named = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("own_id"), F.xxhash64("item_id", "text").alias("item_id"), "text").dropDuplicates(["item_id"])
    named = spool(named, "benchmark")
    items = spool(item_words(named).where(F.size("seeds") > 0), "items")
    docs = docs.where("doc_id is not null")
    upto = Window.orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = items.select("item_id", F.size("words").alias("w"))
    sizes = spool(sizes.select("item_id", (F.coalesce(F.sum("w").over(upto), F.lit(0)) / BLOCK_WORDS).cast("long").alias("block")), "blocks")
    found = []
    for (block,) in sizes.select("block").distinct().orderBy("block").collect():
        some = items.join(sizes.where(F.col("block") == block), "item_id").select("item_id", "words", "seeds")
        flat = some.select("item_id", F.size("seeds").alias("all"), F.posexplode("seeds").alias("place", "seed"))
        known = np.sort(flat.select("seed").distinct().toArrow().column(0).to_numpy().view(np.uint64))
        df = count_seeds(docs, known)
        by_rarity = Window.partitionBy("item_id").orderBy("n", "seed", "place")
        rare = flat.join(df, "seed", "left").fillna(0, ["n"]).withColumn("rank", F.row_number().over(by_rarity)).where(F.col("rank") <= F.ceil(F.col("all") * RARER))
        table = rare.select("seed", "item_id", "place").toPandas().sort_values(["seed", "item_id", "place"], key=lambda c: c.to_numpy().view(np.uint64) if c.name == "seed" else c)
        seeds, first = np.unique(table["seed"].to_numpy().view(np.uint64), return_index=True)
        distinct = table.groupby("item_id")["seed"].nunique()
        needed = {int(i): min(LEAST_SEEDS, int(n)) for i, n in distinct.items()}
        lengths = {r[0]: r[1] for r in some.select("item_id", F.size("words")).collect()}
        near = passages(docs, seeds, np.append(first, len(table)), table["item_id"].to_numpy(), table["place"].to_numpy(), lengths, needed)
        # pairs are few bytes and much work: they are dealt by number and not by size
        dealt = near.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "start")
        found.append(aligned(dealt.join(F.broadcast(some.select("item_id", "words")), "item_id"), threshold))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), "first_word", "end_word")
    told = reduce(DataFrame.unionByName, found).join(named.select("item_id", "own_id"), "item_id").select("doc_id", F.col("own_id").alias("item_id"), "score", "first_word", "end_word")
    return told.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that hold a benchmark item; all columns stay.

    A row is known by a hash of its id and its text, so rows that share an id, or have none, are judged each by its own text.
    """
    key = fresh(docs.columns, "row")
    named = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    bad = contaminated(named.select(F.col(key).alias("doc_id"), "text"), benchmark, threshold).select(F.col("doc_id").alias(key)).distinct()
    return named.join(bad, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
