"""The models as classes: settings at construction, `fit` on (row_id, x, y), then `predict` adds a column `predicted` and `score` rates it.

Thin forms of the functions in `operators.models`; what those state about sizes, ties and signs holds here.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.frame import dimension
from .operators.models import bayes, components, kernels, linear, neighbors
from .operators.optim import Optimizer
from .operators.stats import accuracy


@dataclass
class Estimator:
    """`model` is None before `fit`; `predict` then raises ValueError."""

    model: Any = field(default=None, init=False, repr=False)

    def _train(self, df: DataFrame) -> Any:
        raise NotImplementedError

    def _predicted(self, df: DataFrame) -> DataFrame:
        return df.withColumn("predicted", self.fitted.predict(F.col("x")))

    @property
    def fitted(self) -> Any:
        if self.model is None:
            raise ValueError(f"{type(self).__name__} isn't fitted")
        return self.model

    def fit(self, df: DataFrame) -> Estimator:
        self.model = self._train(df)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        self.fitted  # noqa: B018 (raises where there is no model)
        return self._predicted(df)

    def score(self, df: DataFrame) -> float:
        """The share of rows whose prediction is their label; None for no rows."""
        return self.predict(df).agg(accuracy(F.col("predicted"), F.col("y"))).first()[0]


@dataclass
class KNN(Estimator):
    """Rows are told by `row_id`; one without an answer (no training rows) keeps a null prediction."""

    k: int = 5

    def _train(self, df):
        return df

    def _predicted(self, df):
        found = neighbors.knn_predict(df, self.fitted, self.k)
        return df.join(found.select(F.col("query").alias("_query"), F.col("y").alias("predicted")), F.col("row_id") == F.col("_query"), "left").drop("_query")


@dataclass
class LinearRegression(Estimator):
    learning_rate: float = 0.01
    iterations: int = 1000
    optimizer: str = "gd"
    threshold: float = 0.5

    def _train(self, df):
        return linear.fit_linear(df, self.learning_rate, self.iterations, self.optimizer)

    def score(self, df):
        """The share of labels that the class reading (1 below the threshold) meets."""
        return df.agg(accuracy(self.fitted.score_class(F.col("x"), self.threshold), F.col("y"))).first()[0]


@dataclass
class LogisticRegression(Estimator):
    optimizer: Optimizer | None = None
    iterations: int = 100
    batch_size: int | None = None

    def _train(self, df):
        return linear.fit_logistic(df, self.optimizer, self.iterations, self.batch_size)


@dataclass
class Perceptron(Estimator):
    epochs: int = 300

    def _train(self, df):
        return linear.fit_perceptron(df, self.epochs)


@dataclass
class SVM(Estimator):
    """`dual` solves the quadratic program by interior-point steps, the primal form descends; both take any number of rows."""

    c: float = 1.0
    learning_rate: float = 0.01
    iterations: int = 1000
    dual: bool = False

    def _train(self, df):
        fit = kernels.fit_svm_dual if self.dual else linear.fit_svm_primal
        return fit(df, self.c, self.learning_rate, self.iterations)


@dataclass
class KernelSVM(Estimator):
    kernel: str = "rbf"
    gamma: float = 1.0
    c: float = 1.0
    learning_rate: float = 0.01
    iterations: int = 200

    def _train(self, df):
        return kernels.fit_kernel_svm(df, self.kernel, self.gamma, self.c, self.learning_rate, self.iterations)

    def _predicted(self, df):
        return self.fitted.decision(df).withColumn("predicted", F.when(F.col("decision") >= 0, 1.0).otherwise(-1.0))


@dataclass
class FourierSVM(Estimator):
    features: int = 100
    gamma: float = 0.75
    c: float = 1.0
    learning_rate: float = 0.01
    iterations: int = 1000
    seed: int = 0
    dual: bool = False

    def _train(self, df):
        return kernels.fit_fourier_svm(df, self.features, self.gamma, self.c, self.learning_rate, self.iterations, self.seed, primal=not self.dual)

    def _predicted(self, df):
        return self.fitted.predict(df)


@dataclass
class GaussianNB(Estimator):
    def _train(self, df):
        return bayes.fit_gaussian_nb(df)


@dataclass
class KMeans(Estimator):
    """`model` is the centroids, k x d; `predicted` the number of the nearest one. `score` compares numbers with labels."""

    k: int = 8
    max_iter: int = 100
    seed: int = 0

    def _train(self, df):
        return neighbors.kmeans(df, self.k, self.max_iter, seed=self.seed)[1]

    def _predicted(self, df):
        return neighbors.assign(df, self.fitted).withColumnRenamed("cluster", "predicted")


@dataclass
class PCA(Estimator):
    """`model` is (column means, projection d x k, eigenvalues); `predict` is left to `transform`, which replaces `x`."""

    k: int = 2

    def _train(self, df):
        d = dimension(df)
        mean = np.array(df.agg(F.array(*[F.avg(F.col("x")[j]) for j in range(d)])).first()[0], float)
        return mean, *components.fit_pca(self._centred(df, mean), self.k)

    @staticmethod
    def _centred(df: DataFrame, mean: np.ndarray) -> DataFrame:
        return df.withColumn("x", F.array(*[F.col("x")[j] - F.lit(float(m)) for j, m in enumerate(mean)]))

    def transform(self, df: DataFrame) -> DataFrame:
        mean, projection, _ = self.fitted
        return components.project(self._centred(df, mean), projection)

    def predict(self, df):
        raise TypeError("components predict nothing: use transform")
