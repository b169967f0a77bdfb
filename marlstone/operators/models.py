"""Models on factor panels, by MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.cut import cut as written

C = F.col
FEATURES = ["momentum", "bollinger", "volatility", "volume"]


def forest_scores(panel: DataFrame, label: str = "label", cut: str = "1999-01-01", purge_days: int = 40, trees: int = 20, depth: int = 5) -> DataFrame:
    """Out-of-sample scores from ``cut`` on: a forest on rows that end ``purge_days`` before it, classes weighted evenly.

    (symbol, date, features, label in -1, 0, 1). The score is P(1) - P(-1), the verdict the likeliest class.
    """
    panel = written(panel)  # a fit reads its rows several times over
    day = F.lit(cut).cast("date")
    known = panel.where(C(label).isNotNull()).withColumn("_y", (C(label) + 1).cast("double"))
    train = known.where(C("date") < F.date_sub(day, purge_days))
    sizes = train.groupBy("_y").agg(F.count(F.lit(1)).alias("_k"))
    total = sizes.agg(F.sum("_k").alias("_n"), F.count(F.lit(1)).alias("_c"))
    train = train.join(F.broadcast(sizes.crossJoin(total)), "_y").withColumn("_w", C("_n") / (C("_c") * C("_k")))
    filled = [f"{f}_f" for f in FEATURES]
    steps = [Imputer(strategy="median", inputCols=FEATURES, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), RandomForestClassifier(labelCol="_y", featuresCol="_x", weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=20, featureSubsetStrategy="sqrt", seed=7, probabilityCol="_p")]
    scored = Pipeline(stages=steps).fit(train).transform(panel.where(C("date") >= day)).withColumn("p", vector_to_array("_p"))
    return scored.select("symbol", "date", F.element_at("p", 1).alias("p_down"), F.element_at("p", 2).alias("p_flat"), F.element_at("p", 3).alias("p_up"), (F.element_at("p", 3) - F.element_at("p", 1)).alias("score"), (C("prediction") - 1).cast("int").alias("verdict"))
