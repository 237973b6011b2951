"""Gaussian naive Bayes: class priors, means and floored population variances from one aggregate; scoring is a projection."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import dimension

FLOOR = 1e-6


@dataclass(frozen=True)
class GaussianNB:
    """Arrays over classes 0 .. C - 1: log prior, mean (C x d), variance (C x d). Sent as literals: C * d numbers."""

    log_prior: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    def log_likelihood(self, c: int, x: Column) -> Column:
        """log prior - (sum of ln var + (x - mean)^2 / var) / 2, without the constant in pi."""
        terms = [(x[j] - F.lit(float(m))) * (x[j] - F.lit(float(m))) / F.lit(float(v)) + F.lit(math.log(v)) for j, (m, v) in enumerate(zip(self.mean[c], self.variance[c], strict=True))]
        return F.lit(float(self.log_prior[c])) - F.lit(0.5) * sum(terms[1:], terms[0])

    def predict(self, x: Column) -> Column:
        """The likeliest class, the lowest of equals."""
        scores = [self.log_likelihood(c, x) for c in range(len(self.log_prior))]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        choice = F.lit(len(scores) - 1)
        for c in reversed(range(len(scores) - 1)):
            choice = F.when(scores[c] == best, F.lit(c)).otherwise(choice)
        return choice.cast("int")


def class_stats(df: DataFrame, d: int, x: str = "x", y: str = "y") -> DataFrame:
    """(y, n, mean, variance): arrays over the columns. One shuffle of a row for each class and task."""
    return df.groupBy(F.col(y).cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(F.col(x)[j]) for j in range(d)]).alias("mean"),
        F.array(*[F.greatest(F.var_pop(F.col(x)[j]), F.lit(FLOOR)) for j in range(d)]).alias("variance"),
    )


def fit_gaussian_nb(df: DataFrame, x: str = "x", y: str = "y") -> GaussianNB:
    """Labels must be 0 .. C - 1, all present."""
    rows = sorted(class_stats(df, dimension(df, x), x, y).collect(), key=lambda r: r["y"])
    if [r["y"] for r in rows] != list(range(len(rows))):
        raise ValueError("labels must be 0 .. C - 1, each present")
    total = sum(r["n"] for r in rows)
    return GaussianNB(np.log([r["n"] / total for r in rows]), np.array([r["mean"] for r in rows]), np.array([r["variance"] for r in rows]))
