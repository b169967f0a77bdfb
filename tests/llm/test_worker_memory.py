"""What a Python worker keeps between tasks is bounded, and let go of when another query begins."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

from marlstone.llm import bpe
from marlstone.llm.wordcache import code_point_classes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counting_releases_the_encoder_of_an_earlier_query():
    bpe._HELD["earlier"] = object()
    out = list(bpe.counted(iter([pa.RecordBatch.from_pydict({"text": ["to be or not to be", None]})]), code_point_classes(), "text"))
    assert not bpe._HELD
    assert dict(zip(*(c.to_pylist() for c in out[0].columns), strict=True)) == {"to": 1, " be": 2, " or": 1, " not": 1, " to": 1}


def test_an_encoder_stays_small_however_many_words_it_meets():
    vocabulary, classes = bpe.Vocabulary.load(PATH), code_point_classes()
    lexicon = bpe.Transducer.build([], [])
    texts = [" ".join(np.random.default_rng(k).integers(10**5, 10**6, 20_000).astype(str).tolist()) for k in range(9)]
    texts = [t.translate(str.maketrans("0123456789", "abcdefghij")) for t in texts]
    tracemalloc.start()
    encoder = bpe.Encoder(vocabulary, lexicon, classes)
    for t in texts:
        (ids, raw), = encoder.encode(pa.array([t]))
        assert raw.decode() == t
    held = tracemalloc.get_traced_memory()[0] / 2**20
    tracemalloc.stop()
    assert held < 64, f"{held:.0f} MiB of {len(encoder.texts)} words"
