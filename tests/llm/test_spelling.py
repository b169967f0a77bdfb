"""Spelt words of op7: signs along a Huffman tree of the training documents' bytes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.llm import mixing
from marlstone.llm.labelled import held_out
from marlstone.llm.textbytes import strings


def test_signs_have_a_whole_code_that_is_short_for_common_bytes():
    signs = np.zeros(256, np.int64)
    signs[[mixing.CLOSE, *b"etaoin"]] = [1000, 900, 800, 700, 600, 500, 400]
    codes = mixing.Codes.build(np.zeros(0, np.uint64), np.zeros(0, np.int64), 5, 5, signs)
    size = codes.size[-256:]
    assert size[ord("e")] < 8 and size[mixing.CLOSE] < 8
    assert (0.5 ** size.astype(float)).sum() == 1  # every byte can be spelt, and nothing else
    paths = {tuple(codes.steps[a : a + n].tolist()) for a, n in zip(codes.start[-256:].tolist(), size.tolist(), strict=True)}
    assert len(paths) == 256


def test_fewer_decisions_for_the_same_text():
    data, off = strings(pa.array(["eeee tttt eet"]))
    number = []
    for signs in (None, 100 * np.bincount(data, minlength=256)):
        codes = mixing.Codes.build(np.zeros(0, np.uint64), np.zeros(0, np.int64), 3, 1, signs)
        t = mixing.tokens_of(data, off, codes)
        number.append(mixing.decisions(t, np.arange(len(t.code)), codes)[4][-1])
    assert number[1] < 0.5 * number[0]


def test_bytes_are_counted_in_training_documents_however_they_are_dealt(spark):
    rows = [(i, f"Word{i} aaa\tbb é" * (i % 4)) for i in range(60)] + [(60, None), (None, "zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = "".join(r[0] or "" for r in docs.where(~held_out(F.col("doc_id"), 10)).select("text").collect()).lower().encode()
    for parts in (1, 5):
        got = mixing._chunks(docs.repartition(parts)).where("kind = 2").groupBy("place").agg(F.sum("n")).collect()
        assert dict(map(tuple, got)) == {b: train.count(bytes([b])) for b in set(train)}
