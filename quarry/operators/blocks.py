"""Products of large matrices by blocks, and QR of tall ones by a tree of local steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import dimension
from .linalg import matmul_small
from .ranges import shared

#: Rows and columns of a block; its inner length; triangles that one step of the tree stacks.
SIZE, INNER, FAN = 256, 4096, 16
CELLS = "i array<long>, j array<long>, v array<double>"


def block_matmul(a: DataFrame, b: DataFrame, size: int = SIZE, inner: int = INNER) -> DataFrame:
    """The product of two long matrices (i, j, v), as (i, j, v) of the cells that some product falls on.

    Cells are packed into blocks, one row with arrays each; a task gets the two blocks of one cell of the grid and one slab of the inner index, multiplies them densely
    and returns at most size * size sums. What is shuffled are blocks, as often as the grid has blocks across, and the sums of the slabs, not one row for each
    product; a task holds two blocks of size * inner numbers. Cells that aren't given are 0, cells given twice are added; nulls count as 0. Indices are not negative.
    """

    def packed(cells: DataFrame, outer: str, within: str) -> DataFrame:
        def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            return pa.table({"block": [key[0].as_py()], "slab": [key[1].as_py()], **{c: pa.array([rows.column(c).to_numpy()]) for c in "ijv"}})

        cells = cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
        keyed = cells.withColumn("block", F.floor(F.col(outer) / size).cast("long")).withColumn("slab", F.floor(F.col(within) / inner).cast("long"))
        return shared(keyed.groupBy("block", "slab").applyInArrow(pack, f"block long, slab long, {CELLS}"))

    left, right = packed(a, "i", "j"), packed(b, "j", "i")
    high, wide = (x.agg(F.max("block")).first()[0] for x in (left, right))
    every = lambda most: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-1 if most is None else most).cast("long")) if most is not None else F.array().cast("array<long>"))
    task = ["up", "across", "slab"]
    lefts = left.select(F.col("block").alias("up"), every(wide).alias("across"), "slab", "i", "j", "v")
    rights = right.select(every(high).alias("up"), F.col("block").alias("across"), "slab", "i", "j", "v")

    def dense(rows: pa.Table, up: int, across: int, shape: tuple[int, int]) -> np.ndarray:
        out = np.zeros(shape)
        i, j, v = (rows.column(c).combine_chunks().flatten().to_numpy() for c in "ijv")
        np.add.at(out, (i - up, j - across), v)
        return out

    def product(key: tuple[pa.Scalar, ...], one: pa.Table, other: pa.Table) -> pa.Table:
        up, across, slab = (k.as_py() for k in key)
        if not one.num_rows or not other.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "v": pa.array([], pa.float64())})
        x, y = dense(one, up * size, slab * inner, (size, inner)), dense(other, slab * inner, across * size, (inner, size))
        rows, columns = np.nonzero((x != 0).any(1))[0], np.nonzero((y != 0).any(0))[0]
        out = x[rows] @ y[:, columns]
        return pa.table({"i": np.repeat(rows, len(columns)) + up * size, "j": np.tile(columns, len(rows)) + across * size, "v": out.ravel()})

    return lefts.groupBy(*task).cogroup(rights.groupBy(*task)).applyInArrow(product, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def _triangle(stacked: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, with no negative number on its diagonal: so it is unique where the columns are independent."""
    upper = np.linalg.qr(stacked, mode="r")
    return upper * np.where(np.diag(upper) < 0, -1.0, 1.0)[:, None] if len(upper) == upper.shape[1] else upper


def triangle(df: DataFrame, x: str = "x", fan: int = FAN) -> np.ndarray:
    """R of the QR decomposition of all rows: each task folds its rows into one triangle, batch by batch, and a tree stacks `fan` triangles at a time.

    A task returns d rows at most, the driver gets the last d x d triangle. A row isn't null; no rows give no triangle (0 x 0).
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = None
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("x").flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)
                upper = _triangle(rows if upper is None else np.concatenate([upper, rows]))
        if upper is not None:
            at = pa.array(np.arange(len(upper) + 1) * upper.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(upper.ravel()))], ["x"])

    level = shared(df.select(F.col(x).cast("array<double>").alias("x")).mapInArrow(fold, "x array<double>"))
    while (tasks := level.rdd.getNumPartitions()) > 1:
        level = shared(level.coalesce(-(-tasks // fan)).mapInArrow(fold, "x array<double>"))
    rows = [r["x"] for r in level.collect()]
    return np.array(rows, float) if rows else np.zeros((0, 0))


def tall_qr(df: DataFrame, x: str = "x") -> tuple[DataFrame, np.ndarray]:
    """(`df` with the rows of Q in place of `x`, R) of a tall matrix of d columns; Q isn't formed by the tree but row by row, as x times R's inverse.

    That is done twice, the second time on what came out of the first, so that Q is orthogonal to rounding even for badly conditioned columns.
    Dependent columns have no inverse: an error. R has a positive diagonal.
    """
    d = dimension(df, x)
    first = triangle(df, x)
    if len(first) < d or np.abs(np.diag(first)).min() <= 1e-14 * np.abs(first).max():
        raise ValueError("the columns aren't independent")
    once = matmul_small(df.withColumn(x, F.col(x).cast("array<double>")), np.linalg.inv(first), x, x)
    second = triangle(once, x)
    return matmul_small(once, np.linalg.inv(second), x, x), second @ first
