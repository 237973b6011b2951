"""Order-dependent operators in two levels over ranges by quantiles: as-of joins and scans in which a hot key is spread over tasks.

Rows are range-partitioned by (key, order), so that every task gets about as many, however uneven keys and orders are, and written once to the
shared folder; what a task has to know of the rows before its own is a summary of one row for each task and key.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared(df: DataFrame) -> DataFrame:
    """`df`, written once to the folder that the cluster shares for checkpoints (a temporary one where all runs in one process)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not named and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint()


def _dealt(df: DataFrame, *order) -> DataFrame:
    """Ranges by quantiles of the order, sorted; rows of one order are dealt by an arbitrary last column."""
    return df.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(*order, "_any").sortWithinPartitions(*order, "_any").drop("_any")


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, tie: str, strict: bool = True) -> DataFrame:
    """Each row of `left` with `match`, the last row of `right` (as a struct of its columns) of the same key before it; null without one.

    Before: by `order`, less than the left row's (strict) or at most; of right rows of one order the greatest `tie`, a column of `right`. Rows with a null key or order match
    nothing, null or not; they come back. Every left row comes back once. Left rows go to ranges by quantiles with the right ones between them; a range gets the
    last right row before it from the ranges' summaries. `order` is of one type on both sides.
    """
    own, other = left.columns, right.columns
    before, after = (0, 1) if strict else (1, 0)  # at one order, left rows stand before the right ones, or behind
    usable = F.col(key).isNotNull() & F.col(order).isNotNull()
    l = left.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.lit(before).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*own).alias("_left"), F.lit(None).cast(StructType(right.schema.fields)).alias("_right"))
    r = right.filter(usable).select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.lit(after).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(StructType(left.schema.fields)).alias("_left"), F.struct(*other).alias("_right"))
    rows = shared(_dealt(l.unionByName(r), "_key", "_order", "_side", F.col("_tie").asc_nulls_first()))
    placed = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33))
    within = W.partitionBy("_task", "_key").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    last = placed.groupBy("_task", "_key").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_at"))).alias("_last"))
    ahead = W.partitionBy("_key").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(F.col("_task").alias("_of"), F.col("_key").alias("_name"), F.last("_last", ignorenulls=True).over(ahead).alias("_carried"))
    near = placed.withColumn("_near", F.last("_right", ignorenulls=True).over(within)).filter(F.col("_left").isNotNull())
    found = near.join(carried, (F.col("_task") == F.col("_of")) & F.col("_key").eqNullSafe(F.col("_name")))
    match = F.when(F.col("_key").isNotNull() & F.col("_order").isNotNull(), F.coalesce("_near", "_carried"))
    return found.select(*(F.col("_left")[c].alias(c) for c in own), match.alias("match"))


def interval_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every row of `points` with every row of `intervals` of the same keys whose bounds, both included, hold its value. Column names must differ but for the keys.

    Bins of several widths: an interval belongs to the level of the power of two at least as wide as itself, where it touches two bins at
    most; a point is posted once for each level that has intervals (some dozens at most, whatever the intervals are). Nulls, NaN and intervals that end before they begin join nothing.
    """
    width = F.col(high).cast("double") - F.col(low).cast("double")
    level = F.ceil(F.log2(F.greatest(width, F.lit(2.0**-20)))).cast("int")
    proper = intervals.filter(F.col(low) <= F.col(high)).filter(~F.isnan(F.col(high).cast("double"))).withColumn("_level", level)
    levels = sorted(r[0] for r in proper.select("_level").distinct().collect())  # of the exponents of floating numbers: a bounded set
    at = lambda c, n: F.floor(F.col(c).cast("double") / F.pow(F.lit(2.0), n)).cast("long")
    first, last = at(low, F.col("_level")), at(high, F.col("_level"))
    posted = proper.withColumn("_bin", F.explode(F.sequence(first, last)))
    asked = points.withColumn("_level", F.explode(F.array(*(F.lit(n) for n in levels)) if levels else F.array().cast("array<int>")))
    asked = asked.withColumn("_bin", at(value, F.col("_level")))
    return asked.join(posted, [*keys, "_level", "_bin"]).filter(F.col(value).between(F.col(low), F.col(high))).drop("_level", "_bin")


def interval_sums(points: DataFrame, intervals: DataFrame, key: str, value: str, low: str, high: str, measure: str) -> DataFrame:
    """(key, n, total): for each key of `intervals` how many of `points` lie in its intervals, bounds included, and the sum of their measure; keys without a point are left out.

    What `interval_join` and a group by key would give, without the pairs: both are what lies up to the upper bound less what lies below the lower one. Bounds go between the
    points to ranges by quantiles of the values, a task counts on in Arrow batches, and what lies before it comes from one total for each task. The measure is summed
    in two parts, whole 256ths as integers and the rest, so that narrow intervals lose nothing to the sums before them. Nulls, NaN, infinite points and intervals that
    end before they begin count for nothing; a measure that isn't a number below 2**45 is refused.
    """
    v, bounds = F.col(value).cast("double"), intervals.filter(F.col(low) <= F.col(high)).filter(~F.isnan(F.col(high).cast("double")))
    rows = points.filter(F.abs(v) < float("inf")).select(v.alias("_value"), F.lit(1).alias("_side"), F.lit(None).cast(intervals.schema[key].dataType).alias("_key"), F.coalesce(F.col(measure).cast("double"), F.lit(0.0)).alias("_measure"))
    for bound, side in ((low, 0), (high, 2)):  # at one value, lower bounds stand before the points, upper ones behind
        rows = rows.unionByName(bounds.select(F.col(bound).cast("double").alias("_value"), F.lit(side).alias("_side"), F.col(key).alias("_key"), F.lit(0.0).alias("_measure")))

    def count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, whole, rest, most, kind = 0, 0, 0.0, 0.0, None
        out = lambda keys, signs, ns, wholes, rests: pa.RecordBatch.from_arrays([keys, pa.array(signs), pa.array(ns), pa.array(wholes), pa.array(rests)], ["_key", "_sign", "_n", "_whole", "_rest"])
        for batch in batches:
            side, m = batch.column("_side").to_numpy(), batch.column("_measure").to_numpy()
            most += float(np.abs(m).sum())
            if not most < 2.0**53 or not np.abs(m).max(initial=0.0) < 2.0**45:
                raise ValueError(f"{measure} must be numbers below 2**45")
            units = np.floor(m * 256)
            ns, wholes, rests = n + np.cumsum(side == 1), whole + np.cumsum(units.astype(np.int64)), rest + np.cumsum(m - units / 256)
            at, kind = np.flatnonzero(side != 1), batch.schema.field("_key").type
            if batch.num_rows:
                yield out(batch.column("_key").take(pa.array(at)), (side[at] - 1).astype(np.int32), ns[at], wholes[at], rests[at])
                n, whole, rest = int(ns[-1]), int(wholes[-1]), float(rests[-1])
        if kind is not None:
            yield out(pa.nulls(1, kind), np.zeros(1, np.int32), np.array([n]), np.array([whole]), np.array([rest]))

    names = ("_n", "_whole", "_rest")
    counted = _dealt(rows, "_value", "_side").mapInArrow(count_on, StructType([*rows.select("_key").schema.fields, *StructType.fromDDL("_sign int, _n long, _whole long, _rest double").fields]))
    counted = shared(counted.withColumn("_task", F.spark_partition_id()))  # a row for each bound and task
    ahead = W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    before = counted.filter("_sign = 0").select(F.col("_task").alias("_of"), *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in names))
    found = counted.filter("_sign <> 0").join(F.broadcast(before), F.col("_task") == F.col("_of"))
    sums = found.groupBy(F.col("_key").alias(key)).agg(*(F.sum(F.col("_sign") * (F.col(c) + F.col(f"{c}_before"))).alias(c) for c in names))
    return sums.filter("_n > 0").select(key, F.col("_n").alias("n"), (F.col("_whole") / 256 + F.col("_rest")).alias("total"))


def fold_back(rewards: np.ndarray, gamma: float, carry: float = 0.0) -> np.ndarray:
    """y[i] = rewards[i] + gamma * y[i - 1], with y[-1] = carry, by doubling: (discount, sum) pairs compose, so spans of 1, 2, 4, ... do."""
    out, span, factor = rewards.astype(float).copy(), 1, gamma
    while span < len(out) and factor != 0.0:
        out[span:] += factor * out[:-span].copy()
        span, factor = 2 * span, factor * factor
    return out + carry * gamma ** np.arange(1, len(out) + 1)


def discounted_scan(steps: DataFrame, gamma: float, episode: str, t: str, reward: str) -> DataFrame:
    """`steps` with `ret` = reward + gamma * the next step's ret, and `normalized` by episode (population deviation; unchanged at 1e-8 or less).

    An associative scan from the end: a task folds its range of an episode in Arrow batches, what follows it (one pair of discount and sum for each task
    and episode) is composed over the ranges, and added to each step, discounted by its distance. An episode may be of any length. A null reward
    counts as 0; steps of equal t stand in any turn. Other columns are kept.
    """
    names = steps.columns
    rows = steps.withColumn("_reward", F.coalesce(F.col(reward).cast("double"), F.lit(0.0)))
    order = [F.col(episode), F.col(t).desc()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carry, done = None, 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(episode).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
            values, local, number = batch.column("_reward").to_numpy(), np.empty(batch.num_rows), np.empty(batch.num_rows, np.int64)
            for a, b in zip(starts, starts[1:]):
                own = (batch.column(episode)[a].as_py(),)
                carry, done = (carry, done) if own == key else (0.0, 0)
                local[a:b], number[a:b] = fold_back(values[a:b], gamma, carry), np.arange(done + 1, done + b - a + 1)
                key, carry, done = own, local[b - 1], done + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(number)], [*batch.schema.names, "_local", "_number"])

    dealt = _dealt(rows, *order)
    folded = shared(dealt.mapInArrow(fold, StructType([*dealt.schema.fields, *StructType.fromDDL("_local double, _number long").fields]))).withColumn("_task", F.spark_partition_id())
    pieces = folded.groupBy(F.col(episode).alias("_episode"), "_task").agg(F.max("_number").alias("n"), F.max_by("_local", "_number").alias("last"))

    def follow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_task")
        carry, carries = 0.0, []
        for n, last in zip(group["n"], group["last"], strict=True):
            carries.append(carry)
            carry = last + gamma**n * carry
        return group.assign(carry=carries)[["_episode", "_task", "carry"]]

    kind = pieces.schema["_episode"].dataType.simpleString()
    carried = pieces.groupBy("_episode").applyInPandas(follow, f"_episode {kind}, _task int, carry double").withColumnRenamed("_task", "_of")
    same = F.col(episode).eqNullSafe(F.col("_episode")) & (F.col("_task") == F.col("_of"))
    ret = F.col("_local") + F.col("carry") * F.pow(F.lit(float(gamma)), F.col("_number"))
    returned = folded.join(carried, same).select(*names, "_task", ret.alias("ret"))
    # mean and deviation of an episode from its pieces, back on the pieces: no task gets a whole episode
    sums = returned.groupBy(F.col(episode).alias("_episode"), F.col("_task").alias("_of")).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"), F.var_pop("ret").alias("v"))
    whole = W.partitionBy("_episode")
    total = F.sum("n").over(whole)
    mean = F.sum(F.col("n") * F.col("m")).over(whole) / total
    moments = sums.select("*", mean.alias("_mean"), total.alias("_n"))
    spread = F.sqrt(F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("_mean")) * (F.col("m") - F.col("_mean")))).over(whole) / F.col("_n"))
    moments = moments.select("_episode", "_of", "_mean", spread.alias("_spread"))
    out = returned.join(moments, same)
    return out.select(*names, "ret", F.when(F.col("_spread") > 1e-8, (F.col("ret") - F.col("_mean")) / F.col("_spread")).otherwise(F.col("ret")).alias("normalized"))
