"""The feature-frame contract: (row_id BIGINT, x ARRAY<DOUBLE>, y DOUBLE), and the long form (i BIGINT, j INT, v DOUBLE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def features(df: DataFrame, columns: list[str], row_id: str | Column, label: str | Column | None = None) -> DataFrame:
    """Named numeric columns as one feature vector each, in the order given."""
    out = [F.col(row_id).alias("row_id") if isinstance(row_id, str) else row_id.alias("row_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")]
    if label is not None:
        out.append((F.col(label) if isinstance(label, str) else label).cast("double").alias("y"))
    return df.select(*out)


def dimension(df: DataFrame, x: str = "x") -> int:
    """The vectors' common length. Raises ValueError on an empty frame, a null, or lengths that differ: one aggregate."""
    low, high, nulls, n = df.agg(F.min(F.size(x)), F.max(F.size(x)), F.count_if(F.col(x).isNull()), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("no rows")
    if nulls or low != high or low < 1:
        raise ValueError(f"feature vectors must be non-null and of one length: {nulls} nulls, lengths {low} to {high}")
    return low


def validate_labels(df: DataFrame, allowed: set[float] | None = None, y: str = "y") -> None:
    bad = F.col(y).isNull() | F.isnan(y)
    if allowed is not None:
        bad = bad | ~F.col(y).isin(*[float(v) for v in allowed])
    if df.filter(bad).limit(1).count():
        raise ValueError(f"labels must be among {sorted(allowed)}" if allowed else "labels must be numbers")


def positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0 or v == float("inf"):
            raise ValueError(f"{name} must be a positive number, not {v}")


def to_long(df: DataFrame, row: str = "row_id", x: str = "x") -> DataFrame:
    return df.select(F.col(row).alias("i"), F.posexplode(x).alias("j", "v"))


def to_wide(long: DataFrame, d: int) -> DataFrame:
    """Long cells to vectors; absent cells are 0. One shuffle, a row for each i."""
    cells = long.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("cells"))
    return cells.select(F.col("i").alias("row_id"), F.array(*[F.coalesce(F.try_element_at("cells", F.lit(j)), F.lit(0.0)) for j in range(d)]).alias("x"))
