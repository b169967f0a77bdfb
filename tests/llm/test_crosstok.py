"""Alignment of two tokenizers against plain Python, and hand-built sparse products against dense ones."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marlstone.llm.bpe import byte_alphabet
from marlstone.llm.crosstok import Aligner, Csr, align_documents
from marlstone.llm.wordcache import Spec

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_a int, `a.b` string"
TEXTS = ["The cat's naïve café — 東京!", None, "", " ", "  two  blanks ", "a▁b", "<s> </s> <unk> <0x41>", "a<|endoftext|>b", "tab\tline\n\n", "x\x00y", "é" * 50, "same text", "same text", "12345 67", "\n"]


def brute(rows):
    tk, sp, of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    tk.encode_special_tokens = True
    raw = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    parts, count = [], Counter()
    for i, t in rows:
        ia, ib, links, groups = [], [], [], []
        if t:
            ia, ib = tk.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            ta, tb = [bytes(of[c] for c in tk.id_to_token(x)) for x in ia], [raw(sp.id_to_piece(x)) for x in ib]
            if b"".join(ta) != (" " + t).encode() or b"".join(tb) != (" " + t).encode():
                ia, ib = [], []
            ends_a, ends_b = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
            pa_, pb_ = 0, 0
            for cut in sorted(set(ends_a) & set(ends_b)) if ia else []:
                qa, qb = ends_a.index(cut) + 1, ends_b.index(cut) + 1
                links.append((ia[qa - 1], ib[qb - 1]))
                groups.append((ia[pa_:qa], ib[pb_:qb]))
                pa_, pb_ = qa, qb
        count.update(links)
        parts.append((i, ia, ib, links, groups))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    text = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return sorted(
        (-99 if i is None else i, len(ia), len(ib), len(g), len(k), sum(count[x] == best[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(text(g).encode()).hexdigest() if ia else "", sum(len(x) * len(y) for x, y in g))
        for i, ia, ib, k, g in parts
    )


@pytest.mark.parametrize("most_pairs", [1 << 20, 0])  # counts by a table in every worker, and by a join
def test_alignment_matches_brute_force(spark, most_pairs):
    rng = random.Random(3)
    words = "the quick 'brown' fox jumps, over lazy dogs' tails über straße 100% again".split()
    rows = list(enumerate(TEXTS)) + [(50 + k, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for k in range(40)] + [(None, "no id"), (3, "one id"), (3, "one id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)
    got = sorted((-99 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_shared) for r in align_documents(df, A, B, most_pairs).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert align_documents(spark.createDataFrame([], DOCS), A, B).collect() == []


def test_sparse_products():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = rng.integers(0, 3, (rng.integers(1, 9), 7)) * (rng.random((1, 7)) < 0.7), rng.integers(0, 3, (7, rng.integers(1, 9)))
        sparse = lambda m: Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), np.nonzero(m)[1], m[m != 0], m.shape[1])
        dense = lambda s: np.array([np.bincount(s.cols[a:b], s.vals[a:b], minlength=s.width) for a, b in zip(s.ptr[:-1], s.ptr[1:], strict=True)])
        assert (dense(sparse(x).dot(sparse(y))) == x @ y).all()
        assert (dense(sparse(x).transposed()) == x.T).all()


def test_overlap_and_shared_group_links():
    with open(B, "rb") as f:
        aligner = Aligner(Spec.load(A), f.read())
    x = aligner.align(pa.array(["unbelievable straße", None, "tokenization"]))
    size_a, size_b = aligner.table_a.size[x.a], aligner.table_b.size[x.b]
    span = lambda size: [(e - n, e) for n, e in zip(size.tolist(), np.cumsum(size).tolist(), strict=True)]
    want = {(i, j): min(b, d) - max(a, c) for i, (a, b) in enumerate(span(size_a)) for j, (c, d) in enumerate(span(size_b)) if min(b, d) > max(a, c)}
    assert {(int(i), int(j)): int(v) for i, j, v in zip(x.overlap.rows(), x.overlap.cols, x.overlap.vals, strict=True)} == want
    shared = x.shared_groups()
    group_a, group_b = np.repeat(np.arange(len(x.group_a)), x.group_a), np.repeat(np.arange(len(x.group_b)), x.group_b)
    assert set(zip(shared.rows().tolist(), shared.cols.tolist(), strict=True)) == {(i, j) for i, g in enumerate(group_a) for j, h in enumerate(group_b) if g == h}
    assert x.a_at[1] == x.a_at[2] and x.b_at[1] == x.b_at[2]
