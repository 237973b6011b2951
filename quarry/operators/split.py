"""Splits, samples, batches and shards. Seeded hash orders take the place of shuffles: the same rows in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def seeded(seed: int, *keys: str) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def exact_split(df: DataFrame, fraction: float, key: str, order: Column | None = None, seed: int = 0) -> DataFrame:
    """Adds `is_train`: exactly floor(fraction * n) rows, the first by `order` (default: a seeded hash of the key).

    The cut value is found by counting a histogram of the order first, so that only one bucket of rows is sorted. Nulls come first.
    """
    order = order if order is not None else seeded(seed, key)
    ranked = df.withColumn("_order", order)
    kind = ranked.schema["_order"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        lowest, highest = ranked.agg(F.min("_order"), F.max("_order")).first()
        width = (float(highest) - float(lowest)) / 4096 if lowest is not None and highest > lowest else 1.0
        bucket = F.least(F.lit(4095), F.floor((F.col("_order").cast("double") - F.lit(float(lowest or 0))) / F.lit(width))).cast("int")
    else:  # texts, dates and the like, by sampled cut points that only bound the buckets' sizes
        some = ranked.select("_order").filter("_order is not null").orderBy(F.xxhash64("_order")).limit(4096).distinct()
        cuts = sorted(r["_order"] for r in some.collect())
        cuts = cuts[:: max(1, len(cuts) // 256)]
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_order"))) if cuts else F.lit(0)
    buckets = ranked.withColumn("_bucket", F.when(F.col("_order").isNull(), F.lit(-1)).otherwise(bucket))
    counts = buckets.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # some 4096 rows at most
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = counts.agg(F.floor(F.sum("_n") * F.lit(fraction)).alias("_take"))
    placed = buckets.join(F.broadcast(before.crossJoin(F.broadcast(total))), "_bucket")
    inside = (F.col("_before") < F.col("_take")) & (F.col("_take") < F.col("_before") + F.col("_n"))
    cut = placed.filter(inside).withColumn("is_train", F.row_number().over(W.partitionBy("_bucket").orderBy("_order", key)) + F.col("_before") <= F.col("_take"))
    whole = placed.filter(~inside).withColumn("is_train", F.col("_before") + F.col("_n") <= F.col("_take"))
    return cut.unionByName(whole).drop("_order", "_bucket", "_n", "_before", "_take")


def sample_exact(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows without replacement: a top-k by hash (partial top-k in each task)."""
    return df.orderBy(seeded(seed, key), key).limit(k)


def minibatch(df: DataFrame, b: int, key: str, step: int, seed: int = 0, replacement: bool = False) -> DataFrame:
    """A batch of b rows for a step; with replacement b independent draws, each of any row (none from an empty frame).

    Poisson draws at a rate a little above b: given how many there are, each is of any row alike, so any b of them will do.
    """
    seed = seed * 1_000_003 + step
    if not replacement:
        return sample_exact(df, b, key, seed)
    n, rate = df.count(), b + 6 * b**0.5 + 10
    while n:
        drawn = df.sample(withReplacement=True, fraction=rate / n, seed=seed)
        if drawn.count() >= b:
            return drawn.orderBy(F.rand(seed)).limit(b)
        rate *= 2
    return df


def equal_shard(df: DataFrame, n: int, rank: int, world: int, row: str = "row_id") -> DataFrame:
    """The rank-th contiguous n / world rows by row number; n must divide evenly."""
    if world < 1 or not 0 <= rank < world or n % world:
        raise ValueError(f"{n} rows can't be cut into {world} equal shards, or rank {rank} isn't one of them")
    size = n // world
    return df.filter((F.col(row) >= rank * size) & (F.col(row) < (rank + 1) * size))


def strided_shard(df: DataFrame, rank: int, world: int, row: str = "row_id") -> DataFrame:
    return df.filter(F.pmod(F.col(row), F.lit(world)) == rank)
