"""The pipeline keeps what is clean, its decisions take effect, and the rest of the package works without it."""

import subprocess
import sys

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        mine = [r[0] for r in out.select("doc_id").collect()]
        assert len(mine) == len(set(mine)) and set(mine) <= ids
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name == "line_dedup":
            assert set(mine) == ids
        assert len(mine) > 0.5 * len(ids)
        docs, ids = out, set(mine)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(docs.columns)


def test_nothing_outside_imports_the_subpackage():
    code = "import sys, __spark_entry__; assert not any(m.startswith('marlstone.llm') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
