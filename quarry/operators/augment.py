"""Feature augmentation: none, powers (poly_2 to poly_5), random Fourier features with stored parameters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from .frame import positive
from .linalg import matmul_small


@dataclass(frozen=True)
class FourierFeatures:
    """W (d x D) with deviation sqrt(2 * gamma) and b (D) uniform on [0, 2 pi), drawn once: training and scoring share them."""

    w: np.ndarray
    b: np.ndarray
    scaled: bool = True

    @classmethod
    def draw(cls, d: int, features: int = 100, gamma: float = 0.75, seed: int = 0, scaled: bool = True) -> FourierFeatures:
        positive(features=features, gamma=gamma)
        rng = np.random.Generator(np.random.PCG64(seed))
        return cls(rng.normal(0, np.sqrt(2 * gamma), (d, features)), rng.uniform(0, 2 * np.pi, features), scaled)

    def __call__(self, df: DataFrame, x: str = "x") -> DataFrame:
        """cos(xW + b), times sqrt(2 / D) if scaled."""
        factor = float(np.sqrt(2 / len(self.b))) if self.scaled else 1.0
        shift = F.array(*[F.lit(float(v)) for v in self.b])
        return matmul_small(df, self.w, x, x).withColumn(x, F.zip_with(x, shift, lambda v, b: F.cos(v + b) * F.lit(factor)))

    def of(self, rows: np.ndarray) -> np.ndarray:
        return np.cos(rows @ self.w + self.b) * (np.sqrt(2 / len(self.b)) if self.scaled else 1.0)


def augment(df: DataFrame, kind: str = "none", x: str = "x", fourier: FourierFeatures | None = None) -> DataFrame:
    """kind: none, poly_2 ... poly_5, or rff (with `fourier`)."""
    if kind == "none":
        return df
    if kind in ("poly_2", "poly_3", "poly_4", "poly_5"):
        return df.withColumn(x, arrays.powers(F.col(x), int(kind[-1])))
    if kind == "rff" and fourier is not None:
        return fourier(df, x)
    raise ValueError(f"unknown augmentation {kind!r}, or random Fourier features without their parameters")
