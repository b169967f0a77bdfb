"""Quality classifier: a sparse ensemble of rules (operator 4).

Shallow trees are grown on statistics of labelled texts; every path from a root becomes a rule, a conjunction of comparisons.
A logistic model with an L1 penalty keeps few of them. The kept rules become one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.labelled import held_out, training_rows
from marlstone.llm.textbytes import lower, slices, span_hash, sums, words
from marlstone.llm.workers import alone

TRAIN_ROWS = 6000  # bound on the labelled rows that a model is fitted on
STATS = (
    "n_words", "mean_word", "upper", "digits", "symbols", "marks", "pipes", "spaces", "controls", "high", "repeats", "distinct", "words_per_line", "short_words", "long_words",
)

PREFIX = "stat_"
_KINDS = np.zeros(256, np.int64)  # 0: anything else
_KINDS[ord("A") : ord("Z") + 1] = 1
_KINDS[ord("a") : ord("z") + 1] = 2
_KINDS[ord("0") : ord("9") + 1] = 3
_KINDS[[*b"#$%&*@^~<>{}[]\\/=+_"]] = 4
_KINDS[[*b"!?"]] = 5
_KINDS[[*b"|"]] = 6
_KINDS[[*b" \t"]] = 7
_KINDS[[*b"\n"]] = 8
_KINDS[0x80:] = 9
_KINDS[[*range(9), *range(11, 32), 127]] = 10


def text_stats(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` per text; an empty text has zeros."""
    n, size = len(off) - 1, np.diff(off)
    count = np.bincount(np.repeat(np.arange(n) * 11, size) + _KINDS[data], minlength=11 * n).reshape(n, 11).astype(float)
    starts, ends, first = words(data, off)
    of_words = np.diff(first).astype(float)
    length = ends - starts
    h = span_hash(lower(data), starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    # a distinct (text, word) counts for its text: sort by text, then by hash
    order = np.lexsort((h, doc))
    h_sorted, doc_sorted = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h_sorted[1:] != h_sorted[:-1]) | (doc_sorted[1:] != doc_sorted[:-1])
    per_byte, per_word = np.maximum(size, 1.0), np.maximum(of_words, 1.0)
    letters = np.maximum(count[:, 1] + count[:, 2], 1.0)
    columns = [
        of_words, sums(length, first) / per_word, count[:, 1] / letters, count[:, 3] / per_byte, count[:, 4] / per_byte, count[:, 5] / per_byte, count[:, 6] / per_word, (count[:, 7] + count[:, 8]) / per_byte,
        count[:, 10] / per_byte, count[:, 9] / per_byte, sums(same, first) / per_word, np.bincount(doc_sorted[new], minlength=n) / per_word, of_words / (count[:, 8] + 1.0), sums(length <= 2, first) / per_word, sums(length >= 12, first) / per_word,
    ]
    return np.column_stack([np.asarray(c, float) for c in columns]) if n else np.zeros((0, len(STATS)))


def with_stats(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and one double per name in ``STATS``, called ``stat_`` and that name."""
    at, names, text_at = [rows.columns.index(c) for c in keep], [PREFIX + s for s in STATS], rows.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(it):
            for part, data, off in slices(batch, f"k{text_at}"):
                s = text_stats(data, off)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in at), *(pa.array(np.ascontiguousarray(s[:, k])) for k in range(len(STATS)))], names=[*(f"k{i}" for i in at), *names])

    kept = [T.StructField(f"k{i}", rows.schema[c].dataType) for i, c in zip(at, keep, strict=True)]
    plain = rows.toDF(*(f"k{i}" for i in range(len(rows.columns))))  # a name with a dot in it can't be handed to Python
    out = plain.mapInArrow(batches, T.StructType([*kept, *(T.StructField(s, T.DoubleType()) for s in names)]))
    return out.select(F.struct(*(F.col(f"k{i}").alias(c) for i, c in zip(at, keep, strict=True))).alias("kept"), *names)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it above, threshold) and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, cut in self.terms:
            stat = F.col(PREFIX + STATS[k])
            out = out & (stat > F.lit(cut) if above else stat <= F.lit(cut))
        return F.when(out, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability as one column expression over ``STATS``."""
        z = F.lit(self.bias)
        for r in self.rules:
            z = z + r.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, g: np.ndarray, rows: np.ndarray, feats: np.ndarray, depth: int, cuts: list[np.ndarray], path: tuple, out: set, pred: np.ndarray) -> None:
    """A regression tree on the residuals ``g``; every node's path goes to ``out``, leaf means to ``pred``."""
    if path:
        out.add(tuple(sorted(path)))
    best = (1e-9, None)
    if depth and len(rows) >= 20:
        total, n = g[rows].sum(), len(rows)
        for k in feats:
            if not len(cuts[k]):
                continue
            slot = np.searchsorted(cuts[k], x[rows, k], side="left")
            c = np.cumsum(np.bincount(slot, minlength=len(cuts[k]) + 1))[:-1]
            s = np.cumsum(np.bincount(slot, weights=g[rows], minlength=len(cuts[k]) + 1))[:-1]
            ok = (c >= 5) & (n - c >= 5)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total**2 / n, -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (int(k), float(cuts[k][i])))
    if best[1] is None:
        if len(rows):
            pred[rows] = g[rows].mean()
        return
    k, cut = best[1]
    below = x[rows, k] <= cut
    _grow(x, g, rows[below], feats, depth - 1, cuts, (*path, (k, False, cut)), out, pred)
    _grow(x, g, rows[~below], feats, depth - 1, cuts, (*path, (k, True, cut)), out, pred)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, steps: int = 400, seed: int = 7) -> RuleModel:
    """Boosted shallow trees give the rules; proximal gradient steps with a soft threshold give their weights.

    Without rows, or with one class only, the model is its smoothed prior.
    """
    n, ones = len(y), float(y.sum())
    prior = math.log((ones + 0.5) / (n - ones + 0.5))
    if ones in (0.0, float(n)):
        return RuleModel(prior, ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 60))) for k in range(x.shape[1])]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(cuts)]
    paths: set = set()
    z = np.full(n, prior)
    for _ in range(trees):
        rows = np.flatnonzero(rng.random(n) < 0.6)
        feats = rng.choice(x.shape[1], 8, replace=False)
        g, pred = y - 1 / (1 + np.exp(-z)), np.zeros(n)
        _grow(x, g, rows, feats, depth, cuts, (), paths, pred)
        z += 0.8 * 4 * pred
    terms = sorted(paths)
    if not terms:
        return RuleModel(prior, ())
    r = np.column_stack([np.logical_and.reduce([x[:, k] > c if above else x[:, k] <= c for k, above, c in path]) for path in terms]).astype(np.float64)
    mean = r.mean(0)
    rate = 4.0 / max(np.linalg.norm((r - mean) / np.sqrt(n), 2) ** 2, 1e-9)
    w, v, b, t = np.zeros(r.shape[1]), np.zeros(r.shape[1]), prior, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-((r - mean) @ v + b)))
        grad = (r - mean).T @ (p - y) / n
        new = v - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        b -= 4.0 * float((p - y).mean())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b - mean @ w), tuple(Rule(terms[i], float(w[i])) for i in kept))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> RuleModel:
    """A model from at most ``most`` labelled rows; only their statistics come to the driver."""
    names = [PREFIX + s for s in STATS]
    rows = with_stats(training_rows(docs, labels, label, most).select("y", "text"), ["y"]).select("kept.y", *names).toPandas().sort_values(["y", *names])
    return fit_rules(rows[names].to_numpy(float), rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel, keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """A struct ``kept`` of the columns ``keep`` (the document's id, if not given), whatever their names, with ``score`` and ``predicted``.

    Null and empty texts have statistics of 0 and get a score like any other. Repeated rows give repeated results, an empty
    table an empty one.
    """
    keep = keep or ["doc_id"]
    scored = with_stats(docs.select(*(f"`{c}`" for c in dict.fromkeys([*keep, "text"]))), keep)
    return scored.select("kept", model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, by a model that no held-out row has shaped."""
    return score_quality(docs, fit_quality(docs, labels)).select(F.col("kept.doc_id").alias("doc_id"), held_out(F.col("kept.doc_id"), 5).alias("held_out"), "score", "predicted")
