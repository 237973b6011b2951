"""Principal components from the covariance matrix of centred rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..frame import dimension
from ..linalg import collect_small, matmul_small
from ..stats import covariance

#: Below so many rows the covariance gets RIDGE on its diagonal.
FEW, RIDGE = 200, 1e-5


def fit_pca(centered: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(projection d x k, eigenvalues by falling absolute value) of rows whose columns have mean 0. Signs are arbitrary."""
    d, n = dimension(centered), centered.count()
    if not 1 <= k <= d:
        raise ValueError(f"k must be from 1 to {d}")
    if n < 2:
        raise ValueError("principal components need two rows")
    values, vectors = np.linalg.eigh(collect_small(covariance(centered, n, RIDGE if n < FEW else 0.0), d, d))
    order = np.argsort(-np.abs(values), kind="stable")
    return vectors[:, order[:k]], values[order]


def project(df: DataFrame, components: np.ndarray) -> DataFrame:
    return matmul_small(df, components)
