"""Column statistics, normalisations and metrics: each is one aggregate (partial on the map side) and a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ieee import log_loss as log_loss_of
from .linalg import gramian


def column_stats(df: DataFrame, d: int, x: str = "x") -> DataFrame:
    """One row: mean, std (population), norm: arrays over the d columns."""
    each = lambda f: F.array(*[f(F.col(x)[j]) for j in range(d)])
    return df.agg(each(F.avg).alias("mean"), each(F.stddev_pop).alias("std"), each(lambda v: F.sqrt(F.greatest(F.sum(v * v), F.lit(1e-12)))).alias("norm"))


def _with_stats(df: DataFrame, d: int, x: str, f) -> DataFrame:
    # the statistics are one row of 3 * d numbers
    stats = F.broadcast(column_stats(df, d, x).withColumnRenamed("mean", "_mean").withColumnRenamed("std", "_std").withColumnRenamed("norm", "_norm"))
    return df.crossJoin(stats).withColumn(x, F.array(*[f(F.col(x)[j], j) for j in range(d)])).drop("_mean", "_std", "_norm")


def center(df: DataFrame, d: int, x: str = "x") -> DataFrame:
    return _with_stats(df, d, x, lambda v, j: v - F.col("_mean")[j])


def zscore(df: DataFrame, d: int, x: str = "x", epsilon: float = 1e-8) -> DataFrame:
    """(v - mean) / (population deviation + epsilon), fitted on all rows given."""
    return _with_stats(df, d, x, lambda v, j: (v - F.col("_mean")[j]) / (F.col("_std")[j] + F.lit(epsilon)))


def l2_normalize(df: DataFrame, d: int, x: str = "x") -> DataFrame:
    """Each column over its L2 norm."""
    return _with_stats(df, d, x, lambda v, j: v / F.col("_norm")[j])


def covariance(centered: DataFrame, n: int, ridge: float = 0.0, x: str = "x") -> DataFrame:
    """X'X / (n - 1) + ridge * I of centred rows, long."""
    if n < 2:
        raise ValueError("a covariance needs two rows")
    return gramian(centered, x).withColumn("v", F.col("v") / F.lit(n - 1) + F.when(F.col("i") == F.col("j"), F.lit(float(ridge))).otherwise(F.lit(0.0)))


def accuracy(predicted: Column, actual: Column) -> Column:
    return F.avg((predicted == actual).cast("double"))


def mse(predicted: Column, actual: Column) -> Column:
    return F.avg((predicted - actual) * (predicted - actual))


def mae(predicted: Column, actual: Column) -> Column:
    return F.avg(F.abs(predicted - actual))


def log_loss(p: Column, y: Column, clip: float = 1e-12) -> Column:
    return F.avg(log_loss_of(p, y, clip))


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label for each key, the smallest of equals: two aggregates, no window."""
    votes = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_votes"))
    return votes.groupBy(*keys).agg(F.min(F.struct((-F.col("_votes")).alias("v"), F.col(label).alias("label")))["label"].alias(label))


def cluster_rewards(df: DataFrame, cluster: str, reward: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.avg(reward).alias("mean_reward"), F.stddev_pop(reward).alias("std_reward"), F.count(F.lit(1)).alias("members"))


def outcome_counts(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Wins, losses and draws with their rates."""
    n = F.count(F.lit(1))
    kinds = {"win": "wins", "loss": "losses", "draw": "draws"}
    return df.agg(n.alias("games"), *[F.count_if(F.col(outcome) == k).alias(v) for k, v in kinds.items()], *[(F.count_if(F.col(outcome) == k) / n).alias(f"{k}_rate") for k in kinds])


def running(log: DataFrame, key: str, order: str, value: str, most: int = 100_000, like: DataFrame | None = None) -> DataFrame:
    """`log` with running_sum, running_count and running_max of `value` up to each row, by the number `order` within `key`.

    In two levels, so that one key with most of the rows is spread: rows fall into ranges of `order`, about as many as rows in each;
    totals of the ranges before a row's own are added to what its range has up to it. Rows of equal order count in any turn; a null
    order comes first, null values count for nothing. `like` has the same keys, orders and values and is cheaper to make: the ranges
    and totals are then taken from it, so that `log` is made once.
    """
    base = log if like is None else like
    low, high, n, keys = base.agg(F.min(order), F.max(order), F.count(F.lit(1)), F.count_distinct(key)).first()
    width = (float(high) - float(low)) / max(1.0, float(n) ** 0.5) if low is not None and high > low else 1.0
    at = F.coalesce(F.floor((F.col(order) - F.lit(low or 0)) / F.lit(width)), F.lit(-1)).cast("long")
    ranged = log.withColumn("_range", at)
    totals = base.groupBy(key, at.alias("_range")).agg(F.sum(value).alias("_sum"), F.count(value).alias("_count"), F.max(value).alias("_max"))
    ahead = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.sum("_sum").over(ahead).alias("_sum"), F.sum("_count").over(ahead).alias("_count"), F.max("_max").over(ahead).alias("_max"))
    within = W.partitionBy(key, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    small = F.broadcast if (keys + 1) * (n**0.5 + 2) <= most else (lambda df: df)  # at least as many as there are totals
    each = ranged.join(small(before), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    total = F.when(F.col("_sum").isNull(), F.sum(value).over(within)).otherwise(F.col("_sum") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    each = each.withColumns({"running_sum": total, "running_count": F.coalesce("_count", F.lit(0)) + F.count(value).over(within), "running_max": F.greatest("_max", F.max(value).over(within))})
    return each.drop("_range", "_key", "_at", "_sum", "_count", "_max")


def numbered(log: DataFrame, key: str, order: str, like: DataFrame | None = None) -> DataFrame:
    """`log` with `number`: 1, 2, ... within `key` by the number `order`, a key's rows spread over tasks; equal orders in any turn."""
    one, other = (None if df is None else df.withColumn("_one", F.lit(1)) for df in (log, like))
    return running(one, key, order, "_one", like=other).withColumnRenamed("running_count", "number").drop("_one", "running_sum", "running_max")


def ranked(log: DataFrame, key: str, value: str, order: str, most: int = 100_000) -> DataFrame:
    """`log` with `place`: 1, 2, ... within `key` by falling `value` (nulls last), then by the number `order`.

    The rows of greater values are counted over distinct values, those of the same value by `order` among themselves; so neither a key
    nor a value that most rows have needs one task.
    """
    pair = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    sizes = log.groupBy(F.col(key).alias("_of"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_size")).withColumn("_falling", -F.col("_value").cast("double"))
    known = running(sizes.filter(F.col("_value").isNotNull()), "_of", "_falling", "_size").select("_of", "_value", (F.col("running_sum") - F.col("_size")).alias("_greater"))
    rest = sizes.groupBy("_of").agg(F.coalesce(F.sum(F.when(F.col("_value").isNotNull(), F.col("_size"))), F.lit(0)).alias("_greater"))
    ahead = known.unionByName(rest.select("_of", F.lit(None).cast(log.schema[value].dataType).alias("_value"), "_greater"))
    small = F.broadcast if ahead.count() <= most else (lambda df: df)
    each = numbered(log.withColumn("_pair", pair), "_pair", order)
    each = each.join(small(ahead), F.col("_pair.k").eqNullSafe(F.col("_of")) & F.col("_pair.v").eqNullSafe(F.col("_value")))
    return each.withColumn("place", (F.col("_greater") + F.col("number")).cast("long")).drop("_pair", "_of", "_value", "_greater", "number")


def blocked(log: DataFrame, key: str, order: str, before: int, after: int, block: int = 10_000, like: DataFrame | None = None) -> tuple[DataFrame, W]:
    """(rows, window) for frames of at most `before` rows back and `after` rows on within `key`, in blocks of `block` rows.

    The rows have `number`, their place by `order`, and are dealt to blocks of successive numbers; each block has copies of the rows
    next to it, for which `own` is false: filter on it once the window functions are there. `like`: see `running`.
    """
    if not 0 <= before + after <= block:
        raise ValueError("a block must be longer than its frame")
    at = numbered(log, key, order, like).withColumn("_at", F.floor((F.col("number") - 1) / block))
    inside = F.pmod(F.col("number") - 1, F.lit(block))
    blocks = F.array_compact(F.array(F.col("_at"), F.when(inside >= block - before, F.col("_at") + 1), F.when(inside < after, F.col("_at") - 1)))
    rows = at.withColumn("_block", F.explode(blocks)).withColumn("own", F.col("_block") == F.col("_at")).drop("_at")
    return rows, W.partitionBy(key, "_block").orderBy("number")
