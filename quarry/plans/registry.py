"""Registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL on the same tables."""

    def note(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return note


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, x, y): 64 features, label 0 to 9."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with x = (quantity, extended price, discount, tax) and y = 0, 1, 2 for return flags A, N, R."""
    df = table(spark, sf_dir, "lineitem")
    x = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").cast("array<double>")
    return df.withColumn("x", x).withColumn("y", F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id from 0, x = (size, retail price), y)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("x"), F.col("p_retailprice").cast("double").alias("y"))


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a bandit's: (arm, t, reward)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.col("event_id").alias("t"), F.col("value").cast("double").alias("reward"))


def r(c, digits: int = 6):
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)
