"""What the pipeline's stages hold at once is bounded by them, not by the session's defaults or by the stage before."""

from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import workers


def test_stages_hand_texts_to_python_in_small_batches(spark):
    before = spark.conf.get(corpus_pipeline.BATCH)
    try:
        for given, then in (("10000", "1000"), ("0", "1000"), ("200", "200")):
            spark.conf.set(corpus_pipeline.BATCH, given)
            docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
            corpus_pipeline.line_dedup_stage(spark, docs, "")
            assert spark.conf.get(corpus_pipeline.BATCH) == then
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)


def test_an_operator_that_keeps_nothing_lets_go_of_an_encoder():
    workers.keep("encoder", object)
    first = workers.keep("encoder", object)
    assert workers.keep("encoder", object) is first
    assert list(workers.alone(iter([1, 2]))) == [1, 2] and not workers.HELD
