"""Sharding, secrets, quality, toxicity, BPE and neighbours on small tables, against brute force where there is one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, neighbours, quality, secrets, sharding, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "s", len(t or ""), k) for k, t in enumerate(texts)], DOCS)


def test_sharding_is_gapless_and_a_new_shard_takes_rows_only_into_itself(spark):
    d = docs(spark, [None, "", "é"] + ["same"] * 50 + [str(k) for k in range(400)]).repartition(5)
    rows = sharding.shard_documents(d).collect()
    assert len(rows) == 453
    for s in range(8):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine and mine == list(range(len(mine)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows) and any(r["grown_shard"] == 8 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert (by[0]["size"], by[1]["size"], by[2]["size"]) == (1, 1, 3) and by[2]["text_crc32"] == zlib.crc32("é".encode())


def test_sharding_follows_weights_and_moves_rows_only_where_weights_change(spark):
    heavy = sharding.Node("root", (sharding.Node("a", shard=0, own_weight=3.0), sharding.Node("b", shard=1, own_weight=1.0)))
    more = sharding.Node("root", (sharding.Node("a", shard=0, own_weight=3.0), sharding.Node("b", shard=1, own_weight=2.0)))
    r = spark.range(4000).select(sharding.place(F.col("id"), heavy).alias("x"), sharding.place(F.col("id"), more).alias("y")).collect()
    assert 0.7 < sum(v["x"] == 0 for v in r) / 4000 < 0.8
    assert all(v["x"] == v["y"] or v["y"] == 1 for v in r)


def test_sharding_of_an_empty_table(spark):
    assert sharding.shard_documents(docs(spark, [])).count() == 0


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[r]}:{s}:{e}" for s, r, e in sorted(out))


def test_secrets_match_the_regexes(spark):
    rng = random.Random(3)
    parts = ["token", "secret", "api_key", "APIKEY", "passwd", "=", ":", '"', "'", " ", "abc", "abcdef0123", "/_.=-", "AKIA", "ABCDEFGH01234567", "deadbeef" * 3, "é", "ſecret", "\n", "ghp_" + "a1" * 20]
    texts = [None, "", "token" + " " * 5000 + "= abcdefgh"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(600)]
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert got[k]["base_sha256"] == hashlib.sha256(base_spans(t or "").encode()).hexdigest(), t
    assert sum(r["n_added"] for r in got.values()) > 0


def test_quality_rules_hold_out_and_score_everything(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = docs(spark, [None, "", "word " * 20000], 10_000_000).select(*d.columns)
    out = quality.quality_report(d.unionByName(extra), labels)
    rows = out.join(labels, "doc_id", "left").collect()
    assert len(rows) == d.count() + 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    told = [r for r in rows if r["quality"] is not None]
    assert sum(r["predicted"] == r["quality"] for r in told) / len(told) > 0.85


def test_quality_without_labels_gives_the_prior(spark):
    d = docs(spark, ["a b c", None])
    rows = quality.quality_report(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r["score"] for r in rows} == {0.5}


def test_toxic_words_are_learnt(spark):
    rng = random.Random(1)
    words = ["tree", "house", "river", "cloud", "stone", "field", "bird", "lamp"]
    texts, y = [], []
    for k in range(400):
        t = [rng.choice(words) for _ in range(30)]
        bad = k % 4 == 0
        if bad:
            t[rng.randrange(30)] = rng.choice(["vileword", "nastyword"])
        texts.append(" ".join(t))
        y.append(int(bad))
    labels = spark.createDataFrame([(k, 1, v) for k, v in enumerate(y)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_report(docs(spark, [*texts, None, ""]), labels).collect()
    assert len(rows) == 402
    hold = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["predicted"] == y[r["doc_id"]] for r in hold) / len(hold) > 0.95
    none = [r["score"] for r in rows if r["doc_id"] >= 400]
    assert none[0] == none[1]


def test_bpe_is_what_the_library_gives(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [None, "", "Hello  world's\n\n end ", "naïve 123 ünïcode €", "a<|endoftext|>b", "x" * 3000, "the cat " * 300, "\t tab"]
    for size in (4, 100_000):
        got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, texts), path, size, with_text=True).collect()}
        for k, t in enumerate(texts):
            want = lib.encode(t or "", add_special_tokens=False).ids
            assert list(got[k]["ids"]) == want and got[k]["n_tokens"] == len(want)
            assert got[k]["decoded"] == lib.decode(want, skip_special_tokens=False) == (t or "")
            assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_transducer_is_minimal_and_exact():
    words = sorted(w.encode() for w in ["tap", "taps", "top", "tops", "stop", "stops", "a", ""])
    t = bpe.Transducer.build(words, [[k] for k in range(len(words))])
    assert t.places(words).tolist() == list(range(len(words))) and (t.places([b"ta", b"tapss", b"x"]) == -1).all()
    assert len(t.final) == 7  # start, s, st, t, the shared "p" and its end, and the shared last sign


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:500] = x[7]  # a vector that very many rows share
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0]), (5301, [3.0]), (5400, [2.0])]
    got = neighbours.nearest_of_hundredths(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["query_id"] for r in got} == {*range(0, 1500, 100), 5300, 5400}
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 5300] == [(5400, 1.0), (5301, 2.0)]
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == pytest.approx(d[m[1]], abs=1e-12) for m in mine)
        hit += len(set(want.tolist()) & {m[1] for m in mine})
        if 100 <= q < 500:
            assert [m[1] for m in mine] == [v for v in [7, *range(100, 112)] if v != q][:10]
    assert hit / 150 >= 0.9
    assert neighbours.nearest_of_hundredths(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_columns_that_clash_and_odd_rows(spark):
    """Operators take tables whose other columns are called like their own, with nulls, repeats and a very long text."""
    names = ["_id", "y", "digits", "score", "predicted", "held_out", "flagged", "shard", "slot", "size", "kept", "item_id", "words", "stat_digits"]
    rows = [(None, None), (1, ""), (2, "word " * 50000), (3, "a b c"), (3, "a b c"), (4, "some plain words here")]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(n) for n in names))
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(5)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some plain words here"), (1, "other words than those"), (None, "a b c")], "item_id long, text string")
    assert quality.quality_report(d, labels).count() == 6
    assert toxicity.toxicity_report(d, labels).count() == 6
    assert sharding.shard_documents(d).count() == 6
    assert secrets.find_secrets(d).count() == 6
    from marlstone.llm import decontaminate

    found = decontaminate.contaminated(d, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in found] == [(4, 1, 1.0)]
    assert decontaminate.decontaminate(d, bench).columns == d.columns
    for empty in (d.limit(0),):
        assert quality.quality_report(empty, labels).count() == toxicity.toxicity_report(empty, labels).count() == secrets.find_secrets(empty).count() == 0


def test_bpe_cuts_by_the_librarys_own_classes(spark):
    """code points that two editions of Unicode put in different classes, special tokens beside blanks, and words that tasks meet again."""
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    from marlstone.llm.wordcache import LETTER, NUMBER, code_point_classes

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    classes = code_point_classes()
    odd = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (bool(regex.match(r"\p{L}", chr(c))), bool(regex.match(r"\p{N}", chr(c)))) != (classes[c] == LETTER, classes[c] == NUMBER)]
    rng = random.Random(4)
    texts = [f"ab{chr(c)}1 {chr(c)} x{chr(c)}" for c in odd[:300]] + ["".join(chr(rng.choice([32, 39, 10, 0x2028, 0x3000, rng.randrange(33, 0xD7FF), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(200)]
    texts += ["a <|endoftext|> <|endoftext|>\n\n b", "<|endoftext|>", "it's we'll'", "the same words " * 50]
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, texts).repartition(3), path, with_text=True).collect()}
    for k, t in enumerate(texts):
        want = lib.encode(t, add_special_tokens=False).ids
        assert list(got[k]["ids"]) == want, (k, t)
        assert got[k]["decoded"] == lib.decode(want, skip_special_tokens=False)
