"""Rows without an id or that share one, and columns of any name, through the pipeline's stages."""

import random

import corpus_pipeline
from marlstone.llm.decontaminate import decontaminate
from marlstone.llm.ngramjoin import link_documents, one_of_each

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, kept string, row int, tk int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "dot", "k", 1, 2) for i, t in rows], DOCS)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_near_copies_of_rows_without_an_id(spark):
    rng = random.Random(1)
    w = words(rng, 120)
    near = [*w[:60], "changed", *w[61:]]
    both = link_documents(frame(spark, [(5, " ".join(w)), (None, " ".join(near)), (9, " ".join(words(rng, 50)))]))
    assert sorted(((r.doc_id or 0), r.component_id) for r in both.collect()) == [(0, 5), (5, 5), (9, 9)]
    two = link_documents(frame(spark, [(None, " ".join(w)), (None, " ".join(near)), (9, "x y z")]))
    assert sorted(((r.doc_id or 0), r.component_id or 0) for r in two.collect()) == [(0, 0), (0, 0), (9, 9)]
    kept = one_of_each(frame(spark, [(5, " ".join(w)), (None, " ".join(near)), (None, " ".join(w)), (5, "other text here"), (None, "other text here")]), 5, 80)
    assert sorted((r.doc_id or 0, len(r.text.split())) for r in kept.collect()) == [(5, 3), (5, 120)]  # equal texts are one group


def test_decontamination_judges_each_row_by_its_own_text(spark):
    rng = random.Random(2)
    item = words(rng, 25)
    holds = lambda: " ".join([*words(rng, 30), *item, *words(rng, 30)])
    clean = [" ".join(words(rng, 80)) for _ in range(3)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(words(rng, 25)))], "item_id long, text string")
    docs = frame(spark, [(1, clean[0]), (1, holds()), (None, clean[1]), (None, holds()), (2, None), (3, ""), (4, clean[2]), (4, clean[2])])
    left = decontaminate(docs, bench)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(1, clean[0]), (0, clean[1]), (2, ""), (3, ""), (4, clean[2]), (4, clean[2])])
    assert left.columns == docs.columns
    assert decontaminate(docs.limit(0), bench).collect() == []
    assert decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rng = random.Random(3)
    small = "/root/testdata/sf0.001"
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    docs = frame(spark, [*real, (None, None), (None, ""), (7, " ".join(words(rng, 30))), (7, " ".join(words(rng, 30)))])
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, small)
            rows = out.collect()
            if name != "encoding":
                assert out.columns == docs.columns and all(r["a.b"] == "dot" and r["kept"] == "k" and r["row"] == 1 for r in rows)
            assert len(rows) <= 44 and (given is docs or not rows)
