"""the net of op1 learns from every labelled row outside the held-out fold, whatever their number, and from whole texts of any length."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import toxicity

WORDS = ["tree", "house", "river", "cloud", "stone", "field", "bird", "lamp"]


def test_all_labelled_rows_teach_the_net(spark, monkeypatch):
    rng, learnt = random.Random(2), []
    rows = [(k, " ".join([*rng.choices(WORDS, k=6), *(["vileword"] if k % 5 == 0 else [])]), "en") for k in range(9000)] + [(9001, "stone " * 700000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.contains("text", F.lit("vileword")).cast("int").alias("toxic"))
    averaged = toxicity.averaged
    monkeypatch.setattr(toxicity, "averaged", lambda net, total: learnt.append(total[toxicity.SLOTS * (1 + toxicity.DIM)]) or averaged(net, total))
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 2000)
    rows = toxicity.training_rows(docs, labels, "toxic", None)
    mine = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    assert rows.count() == mine.count() > 7000 and mine.where("doc_id = 9001").count() == 1
    net = toxicity.epoch(rows, toxicity.ConvNet.fresh(11), 4, 0, 0.02, 2.0)
    again = toxicity.epoch(rows.repartition(7), toxicity.ConvNet.fresh(11), 4, 0, 0.02, 2.0)
    assert np.array_equal(net.embed, again.embed) and net.out_bias == again.out_bias
    assert learnt == [rows.count()] * 2
    got = toxicity.score_toxicity(docs, toxicity.train(rows, epochs=2)).join(labels, "doc_id").where("held_out")
    assert got.where("predicted != toxic").count() < 0.02 * got.count()


@pytest.mark.parametrize("least", [1, 30])
def test_thresholds_are_those_of_all_cuts(spark, least):
    rng = random.Random(least)
    rows = []
    for k in range(600):
        z = round(rng.gauss(0, 3), 1) if k % 2 else rng.gauss(0, 0.002)
        rows.append((["en", "fr", None][k % 3] if k < 590 else "few", int(rng.random() < 1 / (1 + np.exp(-z))), z, float(1 / (1 + np.exp(-z)))))
    got = toxicity.thresholds(spark.createDataFrame(rows, "lang string, y int, z double, score double"), least)
    want = {}
    for lang in ("en", "fr", "few"):
        s, t = (np.array([r[c] for r in rows if r[0] == lang]) for c in (3, 1))
        if t.sum() < least:
            continue
        cuts = np.unique(np.concatenate([[0.5], (np.sort(s)[1:] + np.sort(s)[:-1]) / 2]))
        f1 = np.array([2 * (t * (s >= c)).sum() / max(1, (s >= c).sum() + t.sum()) for c in cuts])
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        want[lang] = float(cuts[best[np.abs(cuts[best] - 0.5).argmin()]])
    assert got == pytest.approx(want)
