"""Similarity join on word n-grams by rare-first prefix filtering (operator 9).

Two documents link when 100 * |A & B| >= 85 * |A | B| for their sets of distinct 4-word shingles. The steps:

1. Shingles become 64-bit hashes. How many documents hold them is summed in a table of fixed size by hash slot; sorting a set
   by (slot count, hash) puts rare shingles first. Any order that is the same for all documents keeps the join exact, so
   slots that hashes share cost time, never a link.
2. Documents with equal sets are one class. A class enters with the prefix of its sorted set: two sets that reach the
   threshold share a shingle of both prefixes.
3. Within each prefix shingle every class is first paired with one centre only. What verifies becomes components.
   Then just pairs of classes whose components still differ are formed. So a large group of near copies costs its size, not
   its square, and every pair either is verified once or lies in one component already.
4. Pairs pass filters on length, position and suffix before the sets themselves are fetched and intersected. A pair's first
   common shingle has none before it in common, so it passes the position filter that counts none; and of the smaller set
   only a shorter prefix, the indexed part, can hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.graph import components
from marlstone.llm.spool import reads, spool, unspool
from marlstone.llm.tables import PART, fresh, join_split, summed, table_parts
from marlstone.llm.textbytes import combine, lower, mix64, slices, span_hash, words
from marlstone.llm.workers import alone

SLOT_BITS = 20  # the table of document counts has 2 ** 20 entries of 4 bytes, whatever the corpus
PARTS = 64  # rows in which a task hands on its table
BROADCAST_IDS = 1 << 20  # up to so many document ids (8 MiB) are broadcast; more are joined by a shuffle
RANGES = 32  # parts of the hash space whose counts bound an overlap


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; fewer words are one shingle, no word gives an empty set."""
    starts, ends, first = words(data, off)
    h = span_hash(lower(data), starts, ends)
    grams = combine(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix64(combine(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_sets(n: int) -> Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]]:
    """Shingle sets of a batch with a column ``text``, slice by slice."""

    def sets(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for _, data, off in slices(batch):
            yield shingle_sets(data, off, n)

    return sets


def slot_counts(rows: DataFrame, sets: Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]], bits: int = SLOT_BITS) -> np.ndarray:
    """Sets by slot of their members, over all rows: each task sums its own table, slices of the tables are summed by Spark."""

    def tables(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for batch in alone(it):
            for some in sets(batch):
                if some:
                    slot, times = np.unique((np.concatenate(some) >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
                    total[slot] = np.minimum(total[slot].astype(np.int64) + times, 2**31 - 1)
        yield from table_parts(total, PARTS)

    # counts only put members in order, so those beyond 32 bits may share a place
    return np.minimum(summed(rows.mapInArrow(tables, PART), PARTS, 1 << bits), 2**31 - 1).astype(np.int32).ravel()


def rare_first(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set, its rarest members first: two sets that reach the threshold share a member of both prefixes."""
    bits = len(counts).bit_length() - 1
    keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
    return s[np.lexsort((s, counts[(s >> np.uint64(64 - bits)).astype(np.int64)]))[:keep]]


def shared_grams(postings: DataFrame) -> DataFrame:
    """The postings whose gram occurs more than once. Those of a gram meet in one shuffle and are counted there as a stream."""
    return postings.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("k > 1").drop("k")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, text): a row is known by its id and a hash of its text, so rows that repeat an id with another text stay apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")


def _digest(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix64(s + np.uint64(0x1234567))).astype(np.int64))


def profiles(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, tk, size of the set, a 128-bit digest of the set, counts by hash range, and the rare-first prefix."""
    counts = rows.sparkSession.sparkContext.broadcast(slot_counts(rows.select("text"), text_sets(n)))  # 4 MiB

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(it):
            for part, data, off in slices(batch):
                sets = shingle_sets(data, off, n)
                digests = [_digest(s) for s in sets]
                ranges = [np.bincount((s & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES) for s in sets]
                prefix = [rare_first(s, counts.value, percent).view(np.int64) for s in sets]
                size = pa.array([len(s) for s in sets], pa.int64())
                lo, hi = (pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), size, lo, hi, pa.array(ranges, pa.list_(pa.int32())), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "tk", "n", "lo", "hi", "ranges", "prefix"])

    return rows.mapInArrow(batches, "doc_id long, tk long, n long, lo long, hi long, ranges array<int>, prefix array<long>")


def _enough(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return F.lit(100) * overlap >= F.lit(percent) * (n + m - overlap)


def _length(n: Column, m: Column, percent: int) -> Column:
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _position(i: Column, n: Column, j: Column, m: Column, percent: int) -> Column:
    """For the first shingle that a pair has in common: it and the shorter rest bound the overlap."""
    return _enough(F.least(n - i, m - j), n, m, percent)


def _indexed(pos: Column, n: Column, percent: int) -> Column:
    """Whether a place can hold the first common shingle with a set that is as large or larger."""
    return _enough(n - pos, n, n, percent)


def suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose counts by hash range differ too much: sets that differ by d in some range differ by d in all."""
    ends = classes.select("cid", "n", "ranges")
    both = pairs.join(ends.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("ranges").alias("ra")), "a").join(ends.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("ranges").alias("rb")), "b")
    apart = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return both.where(_enough((F.col("na") + F.col("nb") - apart) / 2, F.col("na"), F.col("nb"), percent)).select("a", "b")


def class_sets(need: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(cid, grams) of the classes in ``need`` (cid, first, lo, hi), each from its first row's text. Up to ``BROADCAST_IDS`` are broadcast."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(it):
            for part, data, off in slices(batch):
                sets = shingle_sets(data, off, n)
                want = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                ok = pa.array([_digest(s) == w for s, w in zip(sets, want, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "grams"]).filter(ok)

    few = need.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = need.select("cid", F.col("first.doc_id").alias("own"), F.col("first.tk").alias("own_tk"), "lo", "hi")
    text = rows.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("tk") == F.col("own_tk"))).select("cid", "lo", "hi", "text")
    return text.mapInArrow(batches, "cid long, grams binary").dropDuplicates(["cid"])


def verify(pairs: DataFrame, classes: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold. Sets are made anew for classes that are in a pair, and for no others."""
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    need = spool(classes.select("cid", "first", "lo", "hi").join(ends, "cid", "left_semi"), "need")
    sets = class_sets(need, rows, n)
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("cid").alias("b"), F.col("grams").alias("gb")), "b")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(it):
            ok = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                shared = len(x) + len(y) - len(np.union1d(x, y))
                ok[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return reads(both.select("a", "b", "ga", "gb").mapInArrow(batches, "a long, b long"), need)


def star_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Each class with one centre by prefix shingle: the class that holds the shingle in the earliest place, which of near copies
    is the least edited one. A column ``prefer``, if there, comes before the place; smaller is better."""
    by = ["prefer"] if "prefer" in postings.columns else []
    centre = postings.where(_indexed(F.col("pos"), F.col("n"), percent)).groupBy("gram").agg(F.min(F.struct(*by, "pos", "cid", "n")).alias("c"))
    met = postings.join(centre, "gram").where((F.col("cid") != F.col("c.cid")) & _length(F.col("n"), F.col("c.n"), percent) & _position(F.col("pos"), F.col("n"), F.col("c.pos"), F.col("c.n"), percent))
    return met.select(F.least("c.cid", "cid").alias("a"), F.greatest("c.cid", "cid").alias("b")).distinct()


def cross_pairs(postings: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a prefix shingle but no component: each against indexed places of sets that are as large or smaller.

    Lengths are cut into bands, so that just sets of like size meet. Members of a component meet members of another one only
    through the pair of components: a group inside one component makes no pair at all.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    held = postings.join(label, "cid", "left").select("gram", "cid", "n", "pos", F.coalesce("root", "cid").alias("root"), band.alias("band"), _indexed(F.col("pos"), F.col("n"), percent).alias("indexed"))
    gram = Window.partitionBy("gram")
    met = held.withColumns({"r0": F.min("root").over(gram), "r1": F.max("root").over(gram), "any": F.max("indexed").over(gram)}).where("r0 != r1 and any")
    held = spool(met.select(*held.columns), "postings")
    probe = held.select("gram", "root", F.col("band").alias("own_band"), F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("band")).distinct()
    target = held.where("indexed").select("gram", F.col("root").alias("other"), "band").distinct()
    met = probe.join(target, ["gram", "band"]).where("root != other").select("gram", "root", F.col("own_band"), "other", "band")
    left = held.select("gram", "root", F.col("band").alias("own_band"), F.col("cid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa")).join(met, ["gram", "root", "own_band"]).select("gram", "a", "na", "pa", F.col("other").alias("root"), "band")
    both = left.join(held.where("indexed").drop("indexed"), ["gram", "root", "band"]).where((F.col("n") <= F.col("na")) & _length(F.col("na"), F.col("n"), percent) & _position(F.col("pa"), F.col("na"), F.col("pos"), F.col("n"), percent))
    return reads(both.select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b")).distinct(), held)


def link_rows(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, tk, n_shingles and first (doc_id, tk of the least row reachable by links) for every row.

    ``tk`` is Spark's xxhash64 of the text. ``first`` is null for rows without a shingle, which link with nothing.
    """
    rows = keyed(docs)
    known = spool(profiles(rows, n, percent), "profiles")
    some = known.where("n > 0")
    classes = some.groupBy("lo", "hi", "n").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tk")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = spool(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    own = some.withColumn("first", F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tk")).select("lo", "hi", "n", "first", "ranges", "prefix")
    profiled = spool(classes.select("cid", "lo", "hi", "n", "first").join(own, ["lo", "hi", "n", "first"]).select("cid", "n", "ranges", "prefix").dropDuplicates(["cid"]), "classes")
    postings = spool(shared_grams(profiled.select("cid", "n", F.posexplode("prefix").alias("pos", "gram"))), "postings")
    stars = spool(suffix_filter(star_pairs(postings, percent), profiled, percent), "pairs")
    met = verify(stars, classes, rows, n, percent)
    links = spool(met, "links")
    found = components(links)
    label = spool(found.select(F.col("node").alias("cid"), "root"), "label")
    unspool(met, links, found)
    crossed = cross_pairs(postings, label, percent)
    rest = spool(suffix_filter(crossed, profiled, percent).join(stars, ["a", "b"], "left_anti"), "pairs")
    unspool(postings, profiled, crossed, stars)
    more = verify(rest, classes, rows, n, percent)
    found = components(label.select(F.col("cid").alias("a"), F.col("root").alias("b")).unionByName(more))
    linked = spool(found.select(F.col("node").alias("cid"), "root"), "linked")
    unspool(more, rest, label, found)
    least = linked.join(classes.select("cid", "first"), "cid").groupBy("root").agg(F.min("first").alias("least"))
    fate = classes.join(linked.join(least, "root").select("cid", "least"), "cid", "left").select("lo", "hi", "n", "copies", F.coalesce("least", "first").alias("first"))
    grouped = join_split(some.select("doc_id", "tk", "lo", "hi", "n"), fate, ["lo", "hi", "n"], "copies").select("doc_id", "tk", F.col("n").alias("n_shingles"), "first")
    bare = known.where("n = 0").select("doc_id", "tk", F.col("n").alias("n_shingles"), F.lit(None).cast("struct<none:boolean,doc_id:bigint,tk:bigint>").alias("first"))
    return reads(grouped.unionByName(bare), known, classes, linked)


def link_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Null and empty texts have no shingles and stay alone, also among themselves. A null id comes after all
    others, so it names a component only where no other id is in it. Rows that repeat an id with another text are documents of their own. An empty
    table gives an empty one; other columns are left out.
    """
    return link_rows(docs, n, percent).select("doc_id", "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The documents without those that link to one before them, by (doc_id, hash of the text); of rows that repeat an id and its text one stays."""
    key, tk = (fresh(docs.columns, c) for c in ("id", "tk"))
    linked = link_rows(docs, n, percent)
    told = spool(linked, "told")
    unspool(linked)
    later = told.where(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.tk") == F.col("tk")))).select(F.col("doc_id").alias(key), F.col("tk").alias(tk)).distinct()
    named = docs.withColumn(tk, F.xxhash64("text"))
    same = lambda t: named["doc_id"].cast("long").eqNullSafe(t[key]) & (named[tk] == t[tk])
    kept = named.join(later, same(later), "left_anti")
    twice = told.groupBy(F.col("doc_id").alias(key), F.col("tk").alias(tk)).count().where("count > 1").select(key, tk)
    if twice.isEmpty():
        return kept.select(*(f"`{c}`" for c in docs.columns))
    single = kept.join(twice, same(twice), "left_anti")
    once = kept.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", tk])
    return single.unionByName(once).select(*(f"`{c}`" for c in docs.columns))
