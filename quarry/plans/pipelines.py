"""Composed jobs: the classification pipeline and the recommender."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.bandit import Session, recommend
from ..operators.frame import dimension
from ..operators.models.bayes import fit_gaussian_nb
from ..operators.models.components import fit_pca, project
from ..operators.models.kernels import fit_svm_dual
from ..operators.models.linear import fit_linear, fit_logistic, fit_perceptron
from ..operators.models.neighbors import kmeans, knn_predict
from ..operators.optim import Optimizer
from ..operators.split import exact_split
from ..operators.stats import accuracy, center, l2_normalize, zscore

#: Rows of a task in a model's training steps.
TASK_BYTES = 32 << 20


def classification_scores(data: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """(model, accuracy) of six models on an exact 80/20 split of (row_id, x, y in 0, 1), standardised on all rows."""
    spark = data.sparkSession
    d = dimension(data)
    # each training step is a job over these rows: as few tasks as cores and memory ask for
    tasks = max(spark.sparkContext.defaultParallelism, -(-data.count() * (d + 2) * 8 // TASK_BYTES))
    split = exact_split(zscore(data, d), 0.8, "row_id", seed=seed).repartition(tasks, "row_id").persist()
    train, test = split.filter("is_train").drop("is_train"), split.filter("not is_train").drop("is_train")
    signed = lambda df: df.withColumn("y", F.when(F.col("y") == 1, 1.0).otherwise(-1.0))
    x, y = F.col("x"), F.col("y")
    nb, svm, linear = fit_gaussian_nb(train), fit_svm_dual(signed(train), iterations=2000), fit_linear(train, 0.1, 500)
    logistic, perceptron = fit_logistic(train, Optimizer("gd", 0.5), 100, start=0.0), fit_perceptron(signed(train), 50)
    found = [(name, float(df.agg(accuracy(p, y)).first()[0])) for name, df, p in (
        ("gaussian_nb", test, nb.predict(x)), ("svm", signed(test), svm.predict(x)), ("perceptron", signed(test), perceptron.predict(x)),
        ("logistic", test, logistic.predict(x)), ("linear", test, linear.score_class(x)))]
    near = knn_predict(test, train, k).withColumnRenamed("y", "found").join(test, F.col("query") == F.col("row_id"))
    found.append(("knn", float(near.agg(accuracy(F.col("found"), y)).first()[0])))
    split.unpersist()
    return spark.createDataFrame(found, "model string, accuracy double")


def recommender(spark: SparkSession, items: DataFrame, target: np.ndarray, clusters: int = 20, components: int = 6, turns: int = 1000, iterations: int = 50, seed: int = 0) -> Session:
    """Normalise, project, cluster, then the bandit's session over the clusters' members.

    All items can be drawn, each as likely as any other of its cluster. The sequential session needs the first `turns` of each
    cluster in a seeded order at most, which go to the driver with the clusters' sizes.
    """
    d = dimension(items)
    ready = center(l2_normalize(items, d), d)
    basis, _ = fit_pca(ready, min(components, d))
    assigned, _ = kmeans(project(ready, basis).select("row_id", "x"), clusters, iterations, seed=seed)
    place = F.row_number().over(W.partitionBy("cluster").orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id"))
    first = assigned.select("row_id", "cluster").withColumn("place", place).filter(F.col("place") <= turns)
    members: dict[int, list] = {}
    for r in first.join(items.select("row_id", "x"), "row_id").orderBy("cluster", "place").collect():
        members.setdefault(r["cluster"], []).append(r["x"])
    sizes = {r["cluster"]: r["count"] for r in assigned.groupBy("cluster").count().collect()}
    return recommend({k: np.array(v) for k, v in members.items()}, target, turns, seed=seed, sizes=sizes)
