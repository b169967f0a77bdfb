"""Merges of new rows into a table by natural key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A new row replaces the old one as a whole; columns it doesn't name become null."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*old.columns)


def ignore_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of a key stays."""
    return old.unionByName(new.join(old, keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def update_columns(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only the columns that new rows name change, and only to values that aren't null."""
    named = [c for c in new.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in named))
    return old.join(n, keys, "full_outer").select(*keys, *(F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in named else F.col(c) for c in old.columns if c not in keys))


def missing_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What has to be written: new rows whose key isn't there."""
    return new.join(old, keys, "left_anti")


def freshness(tables: dict[str, tuple[DataFrame, str]], today: str, stale_after: int = 2) -> DataFrame:
    """Latest date by table, weekdays since then, and whether that is too many. ``today`` is a parameter, never the clock."""
    from functools import reduce

    rows = [df.agg(F.max(F.col(c).cast("date")).alias("max_date")).select(F.lit(name).alias("table_name"), "max_date") for name, (df, c) in tables.items()]
    day = F.lit(today).cast("date")
    lag = F.when(F.col("max_date") < day, F.size(F.filter(F.sequence(F.date_add("max_date", 1), day), lambda d: F.weekday(d) < 5))).otherwise(0)
    return reduce(DataFrame.unionByName, rows).withColumn("lag_days", F.when(F.col("max_date").isNotNull(), lag).cast("long")).withColumn("stale", F.coalesce(F.col("lag_days") > stale_after, F.lit(True)))
