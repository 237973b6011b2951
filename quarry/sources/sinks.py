"""Sinks, and the readers of what they wrote: CSV, JSON, networks and optimizer states as Parquet."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nn import Activation, Dense, Sequential
from ..operators.optim import Optimizer

LAYER = "number int, kind string, inputs int, outputs int, w array<double>, b array<double>"
STATE = "name string, version int, state string"
VERSION = 1


def write_results_csv(df: DataFrame, path: str, order: str) -> None:
    """One file with a header, rows by `order`: for results of a size to look at."""
    df.coalesce(1).sortWithinPartitions(order).write.mode("overwrite").option("header", True).csv(path)


def write_experiment(spark: SparkSession, path: str, name: str, parameters: dict, results: dict) -> None:
    """One JSON document of parameters and result arrays."""
    spark.createDataFrame([(json.dumps({"name": name, "parameters": parameters, "results": results}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_experiment(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def save_network(spark: SparkSession, model: Sequential, path: str) -> None:
    rows = [(i, "dense", layer.w.shape[1], layer.w.shape[0], layer.w.ravel().tolist(), layer.b.tolist()) if isinstance(layer, Dense) else (i, layer.kind, 0, 0, [], []) for i, layer in enumerate(model.layers)]
    spark.createDataFrame(rows, LAYER).coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str, like: Sequential | None = None) -> Sequential:
    """All of a saved network, or ValueError: layers missing, of wrong size, or not of the architecture of `like`."""
    rows = spark.read.schema(LAYER).parquet(path).orderBy("number").collect()
    if [r["number"] for r in rows] != list(range(len(rows))) or any(r["kind"] == "dense" and (len(r["w"]) != r["inputs"] * r["outputs"] or len(r["b"]) != r["outputs"]) for r in rows):
        raise ValueError("a truncated or damaged model")
    model = Sequential([Dense(np.array(r["w"]).reshape(r["outputs"], r["inputs"]), np.array(r["b"])) if r["kind"] == "dense" else Activation(r["kind"]) for r in rows])
    if like is not None and like.signature != model.signature:
        raise ValueError(f"a model of {model.signature}, not of {like.signature}")
    return model


def save_optimizer(spark: SparkSession, optimizer: Optimizer, path: str) -> None:
    spark.createDataFrame([("optimizer", VERSION, json.dumps(optimizer.state()))], STATE).coalesce(1).write.mode("overwrite").parquet(path)


def load_optimizer(spark: SparkSession, path: str) -> Optimizer:
    row = spark.read.schema(STATE).parquet(path).first()
    if row is None or row["name"] != "optimizer" or row["version"] != VERSION:
        raise ValueError("not an optimizer state of a known version")
    return Optimizer.from_state(json.loads(row["state"]))


def save_checkpoint(spark: SparkSession, model: Sequential, optimizer: Optimizer, prefix: str) -> None:
    save_network(spark, model, f"{prefix}.model")
    save_optimizer(spark, optimizer, f"{prefix}.optim")


def load_checkpoint(spark: SparkSession, prefix: str, like: Sequential | None = None) -> tuple[Sequential, Optimizer]:
    return load_network(spark, f"{prefix}.model", like), load_optimizer(spark, f"{prefix}.optim")


def prune_checkpoints(listing: DataFrame) -> DataFrame:
    """The paths that may go: all checkpoints but the best and the final one."""
    return listing.filter(F.coalesce("episode", F.lit(0)) >= 0).select("path")


def delete_checkpoints(spark: SparkSession, path: str) -> list[str]:
    """Deletes the models right under a folder that `prune_checkpoints` names, on whatever file system it is; their names in order."""
    from .readers import checkpoints

    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    named = [hadoop.Path(row["path"]) for row in prune_checkpoints(checkpoints(spark, path)).toLocalIterator()]
    gone = sorted((at for at in named if at.getParent().equals(files.makeQualified(folder))), key=str)
    for at in gone:
        if not files.delete(at, True):
            raise OSError(f"{at} can't be deleted")
    return [at.getName() for at in gone]


def decision_grid(spark: SparkSession, low: float, high: float, side: int) -> DataFrame:
    """(row_id, x): the points of a plot's background, to be scored by a model."""
    from .readers import grid

    return grid(spark, side, low, high)
