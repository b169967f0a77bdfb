"""Toxicity: a convolutional text classifier over hashed word embeddings (operator 1).

A word is a run of letters, digits and bytes above 127, in lower case. Its vector is the sum of the embeddings of hashes of
the whole word and of its first 4 to 8 bytes. Filters of several widths slide over the words, each keeps its largest value
over the whole text, and a logistic unit reads these. All labelled texts teach it: in each pass every shard of them teaches a copy of
the net in numpy, and the copies are averaged; thresholds are then set by language.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.labelled import held_out, training_rows
from marlstone.llm.spool import shuffles_go, spool, unspool
from marlstone.llm.tables import PART, summed, table_parts
from marlstone.llm.textbytes import mix64, slices
from marlstone.llm.workers import alone

SHARD_ROWS, SHARDS = 6000, 256  # rows that teach one copy of the net in a pass, and copies at most: beyond, each has more rows
BATCH, BATCH_BYTES = 32, 4 << 20  # texts of one step, and their bytes; a longer text is a step of its own
SCALE, PARTS = 1 << 24, 16  # weights are summed as whole numbers of this fineness, so sums don't depend on their order
SLOTS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 15, 8, 8, (1, 2, 3), (4, 5, 6, 7, 8)

_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def word_slots(data: np.ndarray, off: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Embedding slots of each word (words x (1 + prefixes); slot 0 stands for none) and the first word of each text."""
    if not len(data):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(len(off), np.int64)
    inside = _WORDLIKE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begin = inside & (np.concatenate([[False], ~inside[:-1]]) | edge[:-1])
    begin[0] = inside[0]
    final = inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(final) + 1
    length = ends - starts
    padded = np.concatenate([_FOLD[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))
    first8, last8 = eight[starts], eight[np.maximum(ends - 8, starts)]
    masks = np.array([(1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], np.uint64)
    first8, last8 = first8 & masks[np.minimum(length, 8)], last8 & masks[np.minimum(length, 8)]
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.int32)
    whole = mix64(first8 ^ (last8 << np.uint64(7)) ^ (last8 >> np.uint64(57)) ^ length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out[:, 0] = whole % np.uint64(slots - 1) + np.uint64(1)
    for j, k in enumerate(PREFIXES, 1):
        has = length > k
        out[has, j] = mix64((first8[has] & masks[k]) ^ np.uint64(k * 0x5851F42D4C957F2D % (1 << 64))) % np.uint64(slots - 1) + np.uint64(1)
    return out, np.searchsorted(starts, off)


@dataclass
class ConvNet:
    embed: np.ndarray  # slots x DIM; row 0 stays 0
    filters: list[np.ndarray]  # by width: width * DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5

    @staticmethod
    def fresh(seed: int, slots: int = SLOTS) -> ConvNet:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.05, (slots, DIM)).astype(np.float32)
        embed[0] = 0
        filters = [rng.normal(0, 0.4 / np.sqrt(w), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return ConvNet(embed, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.3, np.float32), -1.0)

    def pooled(self, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """Largest rectified filter values by text, and where they stand. Texts are padded, so that windows don't cross them."""
        pad = max(WIDTHS) - 1
        n, counts = len(first) - 1, np.diff(first)
        at = np.arange(len(slots)) + np.repeat(np.arange(n) * pad, counts)
        x = np.zeros((len(slots) + n * pad + pad, DIM), np.float32)
        vec = self.embed[slots[:, 0]]
        for j in range(1, slots.shape[1]):
            vec += self.embed[slots[:, j]]
        x[at] = vec
        begin = first[:-1] + np.arange(n) * pad
        top = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        total = len(slots) + n * pad
        acts = []
        for i, w in enumerate(WIDTHS):
            a = sum(x[k : k + total] @ self.filters[i][k * DIM : (k + 1) * DIM] for k in range(w)) + self.bias[i]
            acts.append(a)
            if n:
                top[:, i * FILTERS : (i + 1) * FILTERS] = np.maximum(np.maximum.reduceat(a, begin, axis=0), 0)
        return top, x, begin, acts

    def logit(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        top = self.pooled(slots, first)[0]
        return top @ self.out + self.out_bias

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = self.logit(*word_slots(data, off, len(self.embed))).astype(float)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Learner:
    """A net that learns by Adam on the logistic loss, one small batch after another; ``met`` counts the batches that moved each embedding."""

    def __init__(self, net: ConvNet, ones_weight: float) -> None:
        self.net, self.ones_weight, self.steps, self.mb, self.vb = net, ones_weight, 0, 0.0, 0.0
        self.params = [net.embed, *net.filters, *net.bias, net.out]
        self.m, self.v = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        self.met = np.zeros(len(net.embed), np.int64)

    def step(self, s: np.ndarray, f: np.ndarray, y: np.ndarray, rate: float) -> None:
        net, m, v, pad = self.net, self.m, self.v, max(WIDTHS) - 1
        top, x, begin, acts = net.pooled(s, f)
        p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.out_bias, -30, 30)))
        d = ((p - y) * np.where(y == 1, self.ones_weight, 1.0) / len(y)).astype(np.float32)
        g_out = top.T @ d + 1e-4 * net.out
        g_filters, g_bias, g_embed_at, g_embed = [], [], [], []
        total = len(s) + len(y) * pad
        long = np.diff(np.append(begin, total))
        owner = np.repeat(np.arange(len(y)), long)
        real = np.full(len(x), -1)
        real[np.arange(len(s)) + np.repeat(np.arange(len(y)), np.diff(f)) * pad] = np.arange(len(s))
        for i, w in enumerate(WIDTHS):
            t = top[:, i * FILTERS : (i + 1) * FILTERS]
            at, j = np.nonzero((acts[i] == np.repeat(t, long, axis=0)) & (acts[i] > 0))
            _, first = np.unique(owner[at] * FILTERS + j, return_index=True)  # of equal values the one that stands first
            at, j = at[first], j[first]
            g = d[owner[at]] * net.out[i * FILTERS + j]
            near = at[:, None] + np.arange(w)
            gf, gb = np.zeros((FILTERS, w * DIM), np.float32), np.zeros_like(net.bias[i])
            np.add.at(gf, j, g[:, None] * x[near].reshape(len(at), w * DIM))
            np.add.at(gb, j, g)
            back = (g[:, None] * net.filters[i][:, j].T).reshape(len(at), w, DIM)
            inside = real[near] >= 0
            g_embed_at.append(real[near][inside])
            g_embed.append(back[inside])
            g_filters.append(gf.T)
            g_bias.append(gb)
        self.steps += 1
        fix = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        rows = s[np.concatenate(g_embed_at)]
        if len(rows):
            touched, where = np.unique(rows.ravel(), return_inverse=True)
            ge = np.zeros((len(touched), DIM), np.float32)
            np.add.at(ge, where.ravel(), np.repeat(np.concatenate(g_embed), rows.shape[1], axis=0))
            ge[touched == 0] = 0
            m[0][touched] = 0.9 * m[0][touched] + 0.1 * ge
            v[0][touched] = 0.999 * v[0][touched] + 0.001 * ge**2
            net.embed[touched] -= rate * fix * m[0][touched] / (np.sqrt(v[0][touched]) + 1e-8)
            self.met[touched] += 1
        for k, g in enumerate([*g_filters, *g_bias, g_out], 1):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g**2
            self.params[k] -= (rate * fix * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        gb = float(d.sum())
        self.mb, self.vb = 0.9 * self.mb + 0.1 * gb, 0.999 * self.vb + 0.001 * gb**2
        net.out_bias -= float(rate * fix * self.mb / (np.sqrt(self.vb) + 1e-8))


def _dense(net: ConvNet) -> np.ndarray:
    return np.concatenate([*(p.ravel() for p in (*net.filters, *net.bias, net.out)), [net.out_bias]])


def _size() -> int:
    """Numbers in a table of sums: batches by embedding, embeddings, rows, all other weights; whole parts of it."""
    return -(-(SLOTS * (1 + DIM) + 1 + len(_dense(ConvNet.fresh(0, 1)))) // PARTS) * PARTS


def weighed(learner: Learner, rows: int) -> np.ndarray:
    """A learner's net as whole numbers to be summed: embeddings times the batches that moved them, other weights times its rows."""
    fixed = lambda x: np.rint(x.astype(np.float64) * SCALE).astype(np.int64)
    out = np.concatenate([learner.met, (fixed(learner.net.embed) * learner.met[:, None]).ravel(), [rows], fixed(_dense(learner.net)) * rows])
    return np.append(out, np.zeros(_size() - len(out), np.int64))


def averaged(net: ConvNet, total: np.ndarray) -> ConvNet:
    """The mean of the nets behind ``total``. An embedding is averaged over the learners that moved it, so that a word of few texts isn't held back; one that none moved stays."""
    met, sums = total[:SLOTS], total[SLOTS : SLOTS * (1 + DIM)].reshape(SLOTS, DIM)
    embed = np.where(met[:, None] > 0, sums / np.maximum(met, 1)[:, None] / SCALE, net.embed).astype(np.float32)
    at = SLOTS * (1 + DIM)
    rest = total[at + 1 :] / total[at] / SCALE
    parts, k = [], 0
    for p in (*net.filters, *net.bias, net.out):
        parts.append(rest[k : k + p.size].reshape(p.shape).astype(np.float32))
        k += p.size
    n = len(WIDTHS)
    return ConvNet(embed, parts[:n], parts[n : 2 * n], parts[2 * n], float(rest[k]))


def epoch(rows: DataFrame, net: ConvNet, shards: int, number: int, rate: float, ones_weight: float) -> ConvNet:
    """One pass over all of ``rows`` (doc_id, text, y): each shard's rows, in an order of the pass's own, teach a copy of the net; the copies are averaged.

    Shards and orders follow from ids and texts alone. A task streams its rows, so its memory follows the longest text and not the shard.
    """
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, learner, seen = None, None, None, 0
        for batch in alone(it):
            for part, data, off in slices(batch, most=BATCH_BYTES):
                shard, y = part.column(1).to_numpy(), part.column(2).to_numpy().astype(float)
                slots, first = word_slots(data, off)
                cuts = sorted({*range(0, len(y), BATCH), *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(y)})
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if shard[a] != now:
                        total = weighed(learner, seen) + (0 if total is None else total) if learner else total
                        now, learner, seen = shard[a], Learner(copy.deepcopy(sent.value), ones_weight), 0
                    learner.step(slots[first[a] : first[b]], first[a : b + 1] - first[a], y[a:b], rate)
                    seen += b - a
        if learner:
            yield from table_parts(weighed(learner, seen) + (0 if total is None else total), PARTS)

    dealt = rows.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "y", F.xxhash64("doc_id", "text", F.lit(number)).alias("place"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place").select("text", "shard", "y")
    with shuffles_go(rows.sparkSession):
        return averaged(net, summed(dealt.mapInArrow(learn, PART), PARTS, _size()).ravel())


def train(rows: DataFrame, epochs: int = 8, rate: float = 0.02, seed: int = 11) -> ConvNet:
    """A net that learns from every row (doc_id, text, y), the rarer class weighted up to half its odds. Without both classes it gives the smoothed prior."""
    net = ConvNet.fresh(seed)
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    if ones in (0, n):
        net.out[:], net.out_bias = 0, prior
        return net
    net.out_bias = prior / 2
    shards = min(SHARDS, -(-n // SHARD_ROWS))
    for k in range(epochs):
        net = epoch(rows, net, shards, k, rate * (1 - k / epochs) + 1e-4, float(np.sqrt((n - ones) / ones)))
    return net


def thresholds(scored: DataFrame, least: int = 20) -> dict[str, float]:
    """By language, the cut of (lang, y, z, score) with the best F1, of equal ones the nearest to 0.5; no entry where fewer than ``least`` rows are positive.

    Cuts lie between neighbouring scores, at scores that occur twice, and at 0.5. Scores are summed up within cells of their logit ``z`` and cells by
    language, so no task holds a language: it has at most some 82,000 cells, however many rows. What is broadcast has a row a language.
    """
    one = scored.where("lang is not null").groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), F.floor(F.max("z") * 1024).alias("cell"))
    cells = one.groupBy("lang", "cell").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.max("score").alias("high"))
    down = Window.partitionBy("lang").orderBy(F.desc("cell"))
    over = down.rowsBetween(Window.unboundedPreceding, -1)
    above = cells.select("lang", "cell", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"), F.coalesce(F.sum("ones").over(over), F.lit(0)).alias("ones0"), F.lead("high").over(down).alias("next"))
    inside = Window.partitionBy("lang", "cell").orderBy(F.desc("score"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = one.select("lang", "cell", "score", "n", F.sum("n").over(upto).alias("n1"), F.sum("ones").over(upto).alias("ones1"), F.lead("score").over(inside).alias("lower")).join(above, ["lang", "cell"])
    between, at = (F.col("score") + F.coalesce("lower", "next")) / 2, F.when(F.col("n") > 1, F.col("score"))
    cuts = ranked.select("lang", F.explode(F.array(between, at)).alias("cut"), (F.col("n0") + F.col("n1")).alias("k"), (F.col("ones0") + F.col("ones1")).alias("hit")).where("cut is not null")
    high = F.col("score") >= 0.5
    whole = one.groupBy("lang").agg(F.sum("ones").alias("all"), F.coalesce(F.sum(F.when(high, F.col("n"))), F.lit(0)).alias("k"), F.coalesce(F.sum(F.when(high, F.col("ones"))), F.lit(0)).alias("hit")).where(F.col("all") >= least)
    cuts = cuts.unionByName(whole.select("lang", F.lit(0.5).alias("cut"), "k", "hit")).join(F.broadcast(whole.select("lang", "all")), "lang")
    f1 = cuts.select("lang", "cut", (2 * F.col("hit") / F.greatest(F.lit(1), F.col("k") + F.col("all"))).alias("f1"))
    best = f1.join(F.broadcast(f1.groupBy("lang").agg(F.max("f1").alias("most"))), "lang").where(F.col("f1") >= F.col("most") - 1e-12)
    return {r["lang"]: r["near"]["cut"] for r in best.groupBy("lang").agg(F.min(F.struct(F.abs(F.col("cut") - 0.5).alias("far"), "cut")).alias("near")).orderBy("lang").collect()}  # a row a language


def logits(rows: DataFrame, net: ConvNet) -> DataFrame:
    """(lang, y, z, score) of every row."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(it):
            for part, data, off in slices(batch):
                z = np.clip(sent.value.logit(*word_slots(data, off, len(sent.value.embed))).astype(float), -40, 40)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z), pa.array(1 / (1 + np.exp(-z)))], names=["lang", "y", "z", "score"])

    return rows.select(F.col("lang").cast("string"), "y", "text").mapInArrow(batches, "lang string, y int, z double, score double")


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ConvNet:
    """A net from all labelled texts outside the held-out fold; a fifth of them sets the thresholds by language, the others teach the net."""
    rows = training_rows(docs, labels, label, None)
    rows = spool(rows if "lang" in docs.columns else rows.withColumn("lang", F.lit(None).cast("string")), "labelled")
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 4
    net = train(rows.where(~aside))
    scored = spool(logits(rows.where(aside), net), "scored")
    with shuffles_go(docs.sparkSession):
        net.thresholds = thresholds(scored, 5)
    unspool(rows, scored)
    return net


def score_toxicity(docs: DataFrame, net: ConvNet, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, and by the language's own threshold: lang_threshold, flagged.

    The score comes from the text alone; null and empty texts get the net's value for no word. Rows of an unknown or null
    language use the common threshold. Repeated rows give repeated results, an empty table an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)  # SLOTS x DIM floats and the filters: about 1 MB, whatever the corpus

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, data, off in slices(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 1, 2)), pa.array(sent.value.score(data, off))], names=["doc_id", "held_out", "lang", "score"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), 5).alias("held_out"), lang.alias("lang"), "text")
    scored = rows.mapInArrow(batches, "doc_id long, held_out boolean, lang string, score double")
    cut = F.lit(net.default_threshold)
    for name, value in net.thresholds.items():
        cut = F.when(F.col("lang") == name, F.lit(value)).otherwise(cut)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), cut.alias("lang_threshold"), (F.col("score") >= cut).alias("flagged"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, fit_toxicity(docs, labels))
