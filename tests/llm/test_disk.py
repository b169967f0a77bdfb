"""what the pipeline and op6 write on the way to disk goes when its last reader is done."""

import os
import time
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from marlstone.llm.linededup import dedup_lines
from marlstone.llm.ngramjoin import one_of_each
from marlstone.llm.spool import shared_dir, spool

SF = "/root/testdata/sf0.001"


def shared(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in (files.apply(k).getName() for k in range(files.length())) if x.startswith("shuffle_")}


def test_a_spooled_table_leaves_no_shuffle_files(spark):
    old = shuffles(spark)
    out = spool(spark.range(20000).groupBy((F.col("id") % 5000).alias("k")).count(), "t")
    until = time.time() + 10
    while shuffles(spark) - old and time.time() < until:
        time.sleep(0.1)
    assert not shuffles(spark) - old and out.count() == 5000


def test_op6_and_near_duplicates_keep_only_what_their_result_reads(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for run, kept in ((dedup_lines, "fate"), (lambda d: one_of_each(d, 5, 80), "told")):
        old = shared(spark)
        out = run(docs)
        assert [x.split("-")[0] for x in shared(spark) - old] == [kept]
        assert 0 < out.count() <= docs.count()


def test_pipeline_keeps_its_last_stage_alone(spark):
    old = shared(spark)
    out = corpus_pipeline.run(spark, SF)
    (base,) = [x for x in shared(spark) - old if x.startswith("pipeline-")]
    assert os.listdir(Path(shared_dir(spark).removeprefix("file://"), base)) == [f"{len(corpus_pipeline.STAGES) - 1}-encoding"]
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
