"""Consistency checks; each returns violating rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def out_of_order(rows: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """Rows whose value is below the one before them."""
    before = F.lag(value).over(W.partitionBy(partition).orderBy(order))
    return rows.withColumn("_before", before).where(F.col(value) < F.col("_before")).drop("_before")


def unknown_references(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    return rows.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


KINDS = ["introduce", "update", "restate", "contradict", "delete"]


def illegal_sequence(mutations: DataFrame, *, key: tuple[str, ...] = ("user_id", "slot"), order: str = "seq") -> DataFrame:
    """Changes (key, order, kind, value) that cannot follow what precedes them, with the
    ``error`` each makes.  The active value is that of the last introduction or update,
    unless a delete came after it; an illegal one sets it as well."""
    along = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    setter = F.when(F.col("kind").isin("introduce", "update", "delete"), F.struct(F.when(F.col("kind") != "delete", F.col("value")).alias("v")))
    rows = mutations.withColumn("_now", F.last(setter, ignorenulls=True).over(along)["v"])
    now, same = F.col("_now").isNotNull(), F.col("value") == F.col("_now")
    error = (
        F.when((F.col("kind") == "introduce") & now, "INTRODUCE while fact is active (use UPDATE)")
        .when((F.col("kind") == "update") & ~now, "UPDATE of an inactive fact")
        .when((F.col("kind") == "update") & same, "UPDATE to the same value (use RESTATE)")
        .when((F.col("kind") == "restate") & ~F.coalesce(same, F.lit(False)), "RESTATE must repeat the current value")
        .when((F.col("kind") == "contradict") & ~now, "CONTRADICT of an inactive fact")
        .when((F.col("kind") == "contradict") & same, "CONTRADICT must conflict with the current value")
        .when((F.col("kind") == "delete") & ~now, "DELETE of an inactive fact")
    )
    return rows.withColumn("error", error).where("error IS NOT NULL").drop("_now")
