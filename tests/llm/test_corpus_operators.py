"""Line dedup, similarity join, decontamination, language model and components, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from marlstone.llm import decontaminate, linededup, mixing, ngramjoin
from marlstone.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en" if k % 3 else None, "s", len(t or ""), k) for k, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return [rng.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + rng.choice("ing ed er tion ly".split()) + str(rng.randrange(40)) for _ in range(n)]


def edited(rng, words, k):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = "edit" + str(rng.randrange(10**6))
    return out


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 640)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_similarity_join_matches_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "  ", "one two", "ONE two", "one"]
    base = prose(rng, 80)
    texts += [" ".join(edited(rng, base, k % 4)) for k in range(40)]  # one large group of near copies, some too far from each other
    texts += [" ".join(base)] * 10
    for _ in range(15):
        w = prose(rng, rng.randint(5, 120))
        texts += [" ".join(w), " ".join(edited(rng, w, 1)), " ".join(w[: int(len(w) * 0.9)])]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.link_documents(docs(spark, texts)).collect()}
    assert got == {k: (len(sets[k]), root[k]) for k in range(len(texts))}


def line_links(texts):
    """Components of lines by brute force: (text, line number) -> first place of its component."""
    spots, sets = [], {}
    for k, t in enumerate(texts):
        for i, raw in enumerate((t or "").split("\n") if t is not None else []):
            line = raw.strip(" \t\r\x0b\x0c").encode()
            if line:
                spots.append((k, i, line))
                sets[line] = {line[j : j + 8] for j in range(len(line) - 7)} or {line}
    names = sorted(sets)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in names:
        for y in names:
            if x < y and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                root[find(y)] = find(x)
    first = {}
    for k, i, line in spots:
        first.setdefault(find(line), (k, i))
    return {(k, i): first[find(line)] for k, i, line in spots}


def test_line_dedup_against_brute_force(spark):
    """Families of edited lines: every text is what brute force leaves, up to the links that banding may miss."""
    rng = random.Random(11)
    origins = [" ".join(prose(rng, 14)) for _ in range(12)]
    pool = ["short", "ab", "license line that everyone has"]
    for o in origins:
        pool.append(o)
        for _ in range(18):
            w = list(o)
            for _ in range(rng.choice([1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            pool.append("".join(w))
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(120)] + [None, "", "\n\n", origins[0] * 3000]
    want = line_links(texts)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs(spark, texts).repartition(5), counts=True).collect()}
    wrong = 0
    for k, t in enumerate(texts):
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if want.get((k, i), (k, i)) == (k, i))
        wrong += got[k]["text"] != left
    assert wrong <= 1, wrong


def test_band_recall_at_the_threshold():
    """Of line pairs at a similarity of 0.8 to 0.9, at least 0.98 share a band; from 0.9 on nearly all do."""
    import numpy as np

    rng = random.Random(12)
    hit = {0: [], 1: []}
    for _ in range(4000):
        a = " ".join(prose(rng, 12)).encode()
        b = bytearray(a)
        for _ in range(rng.choice([1, 1, 2])):
            b[rng.randrange(len(b))] = 33
        x, y = linededup.shingle_set(a), linededup.shingle_set(bytes(b))
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        if j >= 0.8:
            data = np.frombuffer(a + bytes(b), np.uint8)
            k = linededup.band_keys(*linededup.shingle_values(data, np.array([0, len(a)]), np.array([len(a), 2 * len(a)])))
            hit[int(j >= 0.9)].append(bool((k[:, 0] == k[:, 1]).any()))
    assert len(hit[0]) > 300 and sum(hit[0]) / len(hit[0]) > 0.98 and (not hit[1] or sum(hit[1]) / len(hit[1]) > 0.995)


def test_lines_that_repeat_go_and_others_stay(spark):
    rng = random.Random(3)
    line = " ".join(prose(rng, 40))
    near = line[:100] + "x" + line[101:]
    texts = [f"{line}\nfirst only\n\nend one", f"start two\n  {line}\nend two", f"{near}\nend three", None, "", "first only", "ab\nab"]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs(spark, texts), counts=True).collect()}
    assert got[0]["text"] == texts[0]
    assert got[1]["text"] == "start two\nend two" and got[2]["text"] == "end three"
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "" and got[6]["text"] == "ab"
    assert got[1]["n_lines"] == 3 and got[1]["n_dropped"] == 1 and got[1]["n_chars"] == len("start two\nend two") and got[1]["extra"] == 1
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_lines_of_rows_that_share_an_id_and_columns_that_clash(spark):
    rows = [(1, "common line here\nonly in a"), (1, "only in b\ncommon line here"), (None, "common line here\nthird"), (2, "same text row"), (2, "same text row")]
    names = ["gone", "tk", "id", "line", "n_lines", "__gone", "h1", "keep", "copies", "root", "nid"]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(7).alias(n) for n in names))
    out = linededup.dedup_lines(d)
    assert out.columns == d.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in out.collect())
    assert got == [(0, "third"), (1, "common line here\nonly in a"), (1, "only in b"), (2, "same text row"), (2, "same text row")]


def test_similarity_join_of_repeated_and_null_ids(spark):
    w = prose(random.Random(8), 40)
    a, b = " ".join(w), " ".join(w[::-1])
    d = spark.createDataFrame([(5, a), (5, b), (3, b + " tail"), (9, a), (None, a), (7, "x " * 60000), (8, "x " * 60000), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in ngramjoin.link_documents(d).collect() if r["n_shingles"])
    assert got == [("3", 3), ("5", 3), ("5", 5), ("7", 7), ("8", 7), ("9", 5), ("None", 5)]
    left = sorted(str(r["doc_id"]) for r in ngramjoin.one_of_each(d.unionByName(d), 5, 80).collect())
    assert left == ["3", "5", "7", "None"]


def test_benchmark_items_are_found_also_when_edited(spark):
    rng = random.Random(4)
    items = [" ".join(prose(rng, 30)) for _ in range(6)] + ["too short", None, ""]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    clean = [" ".join(prose(rng, 200)) for _ in range(30)]
    texts = clean + [clean[0] + " " + items[0].upper() + " " + clean[1], clean[2] + "\n" + " ".join(edited(rng, items[1].split(), 5)), None, "", items[2]]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert set(got) == {(30, 0), (31, 1), (34, 2)}
    assert got[30, 0]["score"] == 1.0 and (got[30, 0]["first_word"], got[30, 0]["end_word"]) == (200, 230)
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert kept == set(range(35)) - {30, 31, 34}


def test_alignment_scores():
    import numpy as np

    a = np.arange(10)
    assert decontaminate.align(a, np.concatenate([[99], a, [98]])) == (20, 11)
    assert decontaminate.align(a, np.concatenate([a[:5], [77], a[5:]]))[0] == 19
    assert decontaminate.align(a, np.array([50, 51])) == (0, 0)


def test_language_model_counts_and_sums_to_one(spark):
    rng = random.Random(6)
    texts = [None, "", "Word word\tWORD\nend"] + [" ".join(prose(rng, 60)) for _ in range(120)]
    rows = {r["doc_id"]: r for r in mixing.score_documents(docs(spark, texts)).collect()}
    tokens = {k: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None] for k, t in enumerate(texts)}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    c = Counter(x for k, t in tokens.items() if not held[k] for x in t)
    n, v = sum(c.values()), len(c)
    for k, t in tokens.items():
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), sum(c[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), rel=1e-9)
        assert r["score"] < 0
    out = [k for k in rows if held[k] and k > 2]
    signs = sum(len(t.encode()) + 1 for k in out for t in tokens[k][:-1])
    assert -sum(rows[k]["score"] for k in out) / math.log10(2) / signs < 4  # bits a byte, on texts that were not learnt from
    assert all(r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / max(1, len((texts[k] or "").encode()))) for k, r in rows.items())


def test_language_model_reads_order_and_not_partitions(spark):
    """Known sentences score above the same words shuffled, and scores don't depend on how rows are dealt."""
    rng = random.Random(9)
    sentences = [" ".join(prose(rng, 12)) for _ in range(30)]
    texts = [" ".join(rng.choice(sentences) for _ in range(6)) for _ in range(150)]
    mixed = []
    for t in texts[:40]:
        w = t.split()
        rng.shuffle(w)
        mixed.append(" ".join(w))
    d = docs(spark, texts + mixed)
    few, many = ({r["doc_id"]: r["score"] for r in mixing.score_documents(d.repartition(p)).collect()} for p in (4, 13))
    assert few == pytest.approx(many, rel=1e-9)
    assert sum(few[k] > few[150 + k] for k in range(40)) == 40


def test_codes_are_complete():
    """Whatever the tables hold, the probabilities of all first tokens sum to one: the tree's leaves do, and so do the signs of a spelling."""
    import numpy as np

    hashes = np.arange(1, 40, dtype=np.uint64) * np.uint64(1 << 40)
    codes = mixing.Codes.build(hashes, np.arange(39) % 7 + 2, 5, 3)
    size = codes.size
    assert sum(2.0 ** -int(s) for s in size[:41]) == 1.0 and (size[41:] == 8).all()
    paths = {tuple(codes.bits[a : a + n]) for a, n in zip(codes.start[:41], size[:41], strict=True)}
    assert len(paths) == 41 and not any(p[:k] in paths for p in paths for k in range(len(p)))


def test_long_null_and_repeated_texts_are_scored(spark):
    rows = [(1, "a b c " * 40000), (1, "a b c " * 40000), (2, None), (None, "a b"), (3, "x" * 300000), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as n", "3 as score", "4 as hash", "5 as tk")
    got = mixing.score_documents(d).collect()
    assert len(got) == 6 and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got} == {120001, 1, 3, 2}


def test_an_empty_corpus(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert ngramjoin.link_documents(none).count() == 0
    assert mixing.score_documents(none).count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0
