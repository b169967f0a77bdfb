"""Where an operator reads one result several times: a reliable checkpoint in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir``; a local session without one gets a folder of its own, a cluster's session must name one."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint()
