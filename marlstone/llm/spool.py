"""Where operators cut lineage: tables written under the folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a local session (as in tests) gets one of its own; a cluster's raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile lets go of its shuffle files when it is done; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: any executor can be lost afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled_at = [path]
    return out


def reads(df: DataFrame, *spooled: DataFrame) -> DataFrame:
    """``df``, noted as a reader of what ``spool`` wrote for the others, so that ``unspool`` of it removes that."""
    df._spooled_at = [path for x in spooled for path in x._spooled_at]
    return df


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unspool(*spooled: DataFrame) -> None:
    """Remove what ``spool`` wrote for exactly these DataFrames; only after their last reader has written its own result."""
    for df in spooled:
        for path in df._spooled_at:
            remove(df.sparkSession, path)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; unlike ``spool`` it keeps partitions as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
