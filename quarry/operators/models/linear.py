"""Linear models: least squares, logistic, perceptron, primal SVM. Each training step is one aggregate over the rows.

Least squares needs one pass in all: gradient descent runs on the sums X'X, X'y, y'y, which give the same iterates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.arrays import dot_values
from ...functions.ieee import sigmoid, sign
from ..frame import dimension, positive, validate_labels
from ..optim import Optimizer, minimize, partial_sums
from ..split import minibatch


#: Rows of a sequential learner that are fetched once rather than once an epoch.
HELD_BYTES = 32 << 20


@dataclass(frozen=True)
class Linear:
    """w.x + b."""

    w: np.ndarray
    b: float

    def raw(self, x: Column) -> Column:
        return dot_values(x, list(self.w)) + F.lit(float(self.b))


class LinearRegression(Linear):
    def predict(self, x: Column) -> Column:
        return self.raw(x)

    def score_class(self, x: Column, threshold: float = 0.5) -> Column:
        """1 where the prediction is *below* the threshold: the accuracy of this model is defined on that reading."""
        return F.when(self.raw(x) < threshold, F.lit(1)).otherwise(F.lit(0))


class LogisticRegression(Linear):
    def probability(self, x: Column) -> Column:
        return sigmoid(self.raw(x))

    def predict(self, x: Column) -> Column:
        return F.when(self.probability(x) >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))


class Perceptron(Linear):
    def predict(self, x: Column) -> Column:
        return sign(self.raw(x), zero=-1)


class LinearSVM(Linear):
    def predict(self, x: Column) -> Column:
        return sign(self.raw(x), zero=1)


def least_squares_sums(df: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """X'X and X'y of rows with a 1 appended, y'y, and n: one pass."""
    d = dimension(df)

    def each(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        one = np.hstack([rows, np.ones((len(rows), 1))])
        return np.concatenate([(one.T @ one).ravel(), one.T @ y, [y @ y, len(y)]])

    s = partial_sums(df, each)
    e = d + 1
    return s[: e * e].reshape(e, e), s[e * e : e * e + e], float(s[-2]), float(s[-1])


def fit_linear(df: DataFrame, lr: float = 0.01, iterations: int = 1000, optimizer: str = "gd") -> LinearRegression:
    """Mean squared error (no half), full batch, from w = b = 1."""
    positive(lr=lr)
    xx, xy, _, n = least_squares_sums(df)
    theta = minimize(lambda t: 2 * (xx @ t - xy) / n, np.ones(len(xy)), Optimizer(optimizer, lr), iterations)
    return LinearRegression(theta[:-1], float(theta[-1]))


def descend(df: DataFrame, gradient: Callable, start: np.ndarray, optimizer: Optimizer, iterations: int, batch_size: int | None = None, seed: int = 0) -> np.ndarray:
    """Steps along mean gradients; `gradient(theta, X, y)` gives sums over rows. Full batches, or mini-batches by row_id."""
    kept = df.persist()
    try:
        step = iter(range(iterations))

        def mean(theta: np.ndarray) -> np.ndarray:
            part = kept if batch_size is None else minibatch(kept, batch_size, "row_id", next(step), seed)
            s = partial_sums(part, lambda rows, y, t=theta: np.append(gradient(t, rows, y), len(y)))
            return s[:-1] / s[-1]

        return minimize(mean, start, optimizer, iterations)
    finally:
        kept.unpersist()


def logistic_gradient(theta: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-(rows @ theta[:-1] + theta[-1])))
    return np.append(rows.T @ (p - y), (p - y).sum())


def fit_logistic(df: DataFrame, optimizer: Optimizer | None = None, iterations: int = 100, batch_size: int | None = None, start: float | None = None, seed: int = 0) -> LogisticRegression:
    """Mean cross-entropy for labels 0 and 1, from w = 5, b = 1, or all at `start`."""
    validate_labels(df, {0.0, 1.0})
    d = dimension(df)
    first = np.append(np.full(d, 5.0), 1.0) if start is None else np.full(d + 1, start)
    theta = descend(df, logistic_gradient, first, optimizer or Optimizer("gd", 0.1), iterations, batch_size, seed)
    return LogisticRegression(theta[:-1], float(theta[-1]))


def hinge_gradient(rows: np.ndarray, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Sum of the hinge's slopes; at the kink the mean of both sides, as central differences give."""
    share = np.where(np.abs(1 - margin) < 1e-12, 0.5, (margin < 1).astype(float))
    return np.append(-(rows * (share * y)[:, None]).sum(0), -(share * y).sum())


def fit_svm_primal(df: DataFrame, c: float = 1.0, lr: float = 0.01, iterations: int = 100, optimizer: str = "gd", hold: bool = False) -> LinearSVM:
    """w.w / 2 + C * mean hinge for labels -1 and 1, from 0. Each step is an aggregate; with `hold`, up to HELD_BYTES of rows are
    fetched once and summed on the driver, which gives the same sums without a job for each step.
    """
    positive(c=c, lr=lr)
    validate_labels(df, {-1.0, 1.0})
    d = dimension(df)
    kept = df.persist()
    held = None
    if hold and kept.count() * (d + 1) * 8 <= HELD_BYTES:
        table = kept.select("x", "y").toArrow().combine_chunks()
        held = table.column("x").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, d), table.column("y").to_numpy().astype(float)

    def gradient(theta: np.ndarray) -> np.ndarray:
        each = lambda rows, y, t=theta: np.append(hinge_gradient(rows, y, y * (rows @ t[:-1] + t[-1])), len(y))
        s = each(*held) if held is not None else partial_sums(kept, each)
        return np.append(theta[:-1], 0.0) + c * s[:-1] / s[-1]

    theta = minimize(gradient, np.zeros(d + 1), Optimizer(optimizer, lr), iterations)
    kept.unpersist()
    return LinearSVM(theta[:-1], float(theta[-1]))


def fit_perceptron(df: DataFrame, epochs: int = 300, order: str = "row_id") -> Perceptron:
    """Mistake-driven updates, row after row by `order`, until an epoch without mistakes.

    Sequential by definition. Up to HELD_BYTES of rows are fetched once; beyond, rows stream through the driver in order, one
    partition at a time, once for each epoch.
    """
    positive(epochs=epochs)
    validate_labels(df, {-1.0, 1.0})
    d = dimension(df)
    w, b = np.zeros(d), 0.0
    rows = df.orderBy(order).select("x", "y").persist()
    held = rows.collect() if rows.count() * (d + 1) * 8 <= HELD_BYTES else None
    for _ in range(epochs):
        mistakes = 0
        for r in held if held is not None else rows.toLocalIterator(prefetchPartitions=True):
            x = np.asarray(r["x"], float)
            if (1 if w @ x + b > 0 else -1) != r["y"]:
                w, b, mistakes = w + r["y"] * x, b + r["y"], mistakes + 1
        if not mistakes:
            break
    rows.unpersist()
    return Perceptron(w, b)
