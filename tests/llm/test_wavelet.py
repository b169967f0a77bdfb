"""Shard files of token ids: the library's own tokens, round trips, and rank and select against plain counting."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marlstone.llm.wavelet import Shard, index_documents, token_count, token_positions, write_shards
from marlstone.llm.wordcache import Spec, WordEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, start int, `a.b` string"


@pytest.fixture(scope="module")
def spec():
    return Spec.load(PATH)


def random_texts(rng, n):
    signs = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", " ", " ", "a", "B", "é", "中", "1", "½", ".", "…", "😀", "'S", "<|endoftext|>", "s", "\r\n", "́", "_", "-"]
    some = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(n)]
    return some + ["".join(chr(rng.choice([rng.randrange(0x300), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(n // 4)]


def test_words_are_cut_and_encoded_as_the_library_does(spec):
    texts = [*random_texts(random.Random(1), 4000), None, "", "x" * 5000, " " * 5000, "the cat's 12 dogs'll"]
    for plain in (False, True):
        ids, at = WordEncoder(spec, plain).encode(pa.array(texts))
        want = [e.ids for e in spec.tokenizer(plain).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_rank_select_access_and_count():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 50257, 60000), rng.integers(0, 20, 30000), np.full(50000, 13)])
    rng.shuffle(ids)
    shard = Shard(Shard.build(ids, np.array([10, len(ids)]), np.array([4, 9]), np.array([True, False]), 16))
    assert (shard.decode() == ids).all()
    assert [a.tolist() for a in shard.documents()] == [[4, 9], [True, False], [10, len(ids)]]
    for token in (13, 0, 19, 50256, int(ids[5]), 60000):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places) and (shard.occurrences(token) == places).all()
        assert [shard.rank(token, p) for p in (0, 1, 65535, 65536, 65537, len(ids))] == [(ids[:p] == token).sum() for p in (0, 1, 65535, 65536, 65537, len(ids))]
        for k in range(0, len(places), max(1, len(places) // 5)):
            assert shard.select(token, k) == places[k]
    assert [shard.access(p) for p in (0, 65535, 65536, len(ids) - 1)] == [ids[p] for p in (0, 65535, 65536, len(ids) - 1)]
    with pytest.raises(IndexError):
        shard.select(13, shard.count(13))
    assert shard.count(1 << 20) == 0


def test_documents_read_back(spark, tmp_path):
    rng = random.Random(2)
    texts = [*random_texts(rng, 60), None, "", "again and again", "again and again", "z " * 4000]
    rows = [(rng.randrange(-5, 200), t) for t in texts] + [(None, "no id"), (None, None), (7, "one id"), (7, "two texts"), (7, "two texts")]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], DOCS)
    tk = Tokenizer.from_file(PATH)
    code = lambda t: tk.encode(t or "", add_special_tokens=False).ids + [0]
    got = index_documents(df, PATH, shard_tokens=500).collect()
    # of rows that share an id the order isn't set, so each must be there once and they must lie end to end by id
    want = sorted((-99 if i is None else i, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, t in rows for c in [code(t)])
    assert sorted((-99 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    lay = sorted(got, key=lambda r: r.start)
    assert [r.start for r in lay] == np.cumsum([0, *(r.n_tokens for r in lay)])[:-1].tolist()
    assert [-99 if r.doc_id is None else r.doc_id for r in lay] == sorted(-99 if i is None else i for i, _ in rows)
    manifest = write_shards(df, PATH, f"file://{tmp_path}/w", shard_tokens=300)
    assert manifest.count() >= 5
    token = code("again and again")[0]
    assert token_count(manifest, token) == sum(code(t).count(token) for _, t in rows)
    found = sorted((-99 if r.doc_id is None else r.doc_id, r.place) for r in token_positions(manifest, token).collect())
    assert found == sorted((-99 if i is None else i, p) for i, t in rows for p, x in enumerate(code(t)) if x == token)


def test_empty_table(spark):
    assert index_documents(spark.createDataFrame([], DOCS), PATH).collect() == []
