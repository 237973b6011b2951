"""Structured Streaming: event-time windows with watermarks, sessions, and stateful learners.

Stateful operators keep a bounded state for each key (an arm's count and mean; a replay buffer of fixed size). Rows of a
micro-batch are put in event order before the state sees them. State stores are checkpointed by Spark and survive lost executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def tumbling(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n, mean): late rows count until the watermark has passed the window."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def sliding(events: DataFrame, ts: str, value: str, width: str = "1 hour", slide: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width, slide)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def interval_joined(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, delay: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Rows of two streams of the same key, the right one up to `within` after the left one (both ends included).

    Both sides have a watermark, and the condition bounds how far their times differ, so a row leaves the state once no partner can come. Rows later than
    the watermark are dropped. `left_outer`: a left row without a partner comes out when the watermark has passed its time and `within`. Time columns must be
    named differently; null keys and times join nothing.
    """
    a, b = left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay).withColumnRenamed(key, "_key")
    near = (F.col(key) == F.col("_key")) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {within}"))
    return a.join(b, near, how).drop("_key")


class SessionProcessor(StatefulProcessor):
    """Open sessions of a key, merged as rows come in any order, put out and forgotten by a timer when the watermark has passed their gap."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(map(int, x)) for x in self.open.get()] if self.open.exists() else []
        for batch in rows:
            at = batch["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            held += [(t, t, 1) for t in at]
        merged: list[tuple[int, int, int]] = []
        for first, last, n in sorted(held):
            if merged and first - merged[-1][1] < self.gap * 1000:
                merged[-1] = (merged[-1][0], max(merged[-1][1], last), merged[-1][2] + n)
            else:
                merged.append((first, last, n))
        self.open.put(merged)
        known = {int(t) for t in self.handle.listTimers()}
        for _, last, _ in merged:
            if (due := -(-last // 1000) + self.gap) not in known:
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, held = timerValues.getCurrentWatermarkInMs(), [tuple(map(int, x)) for x in self.open.get()] if self.open.exists() else []
        closed = [s for s in held if -(-s[1] // 1000) + self.gap <= passed]
        left = [s for s in held if s not in closed]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        if closed:
            time = lambda k: pd.to_datetime([s[k] for s in closed], unit="us")
            yield pd.DataFrame({"user_id": [key[0]] * len(closed), "start": time(0), "last": time(1), "n": [s[2] for s in closed]})

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, gap_ms: int, delay: str = "0 seconds") -> DataFrame:
    """(user_id, start, last, n) of each session of a stream (user_id, ts) once it is over: no row of the user for `gap_ms` up to the watermark.

    Event-time timers close sessions, so state is kept for open ones only; rows later than the watermark are dropped.
    """
    return events.withWatermark("ts", delay).groupBy("user_id").transformWithStateInPandas(SessionProcessor(gap_ms), "user_id long, start timestamp, last timestamp, n long", "Append", "EventTime")


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's rows in a folder named by its number, written anew when the batch is repeated: exactly once."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What batch_sink has written under `path`, with `batch`; no rows where there was no batch."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = StructType([*schema.fields, StructField("batch", LongType())])
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


class ArmProcessor(StatefulProcessor):
    """Count and running mean of each arm's rewards."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("arm", "pulls long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pulls, value = self.state.get() if self.state.exists() else (0, 0.0)
        batch = pd.concat(rows).sort_values(["t"], kind="stable")
        for reward in batch["reward"]:
            pulls += 1
            value += (reward - value) / pulls
        self.state.update((pulls, value))
        yield pd.DataFrame({"arm": [key[0]], "pulls": [pulls], "value": [value]})

    def close(self) -> None:
        pass


class ReplayProcessor(StatefulProcessor):
    """The last `keep` rewards of each key, in event order."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("recent", "t long, reward double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.state.get()) if self.state.exists() else []
        batch = pd.concat(rows)
        held = sorted([*((int(t), float(r)) for t, r in held), *zip(batch["t"].astype(int).tolist(), batch["reward"].astype(float).tolist(), strict=True)])[-self.keep :]
        self.state.put(held)
        yield pd.DataFrame({"arm": [key[0]], "held": [len(held)], "mean": [sum(r for _, r in held) / len(held)], "last": [held[-1][0]]})

    def close(self) -> None:
        pass


#: Stateful operators need it: the owner of a session sets it before a stream begins.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _stateful(log: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return log.groupBy("arm").transformWithStateInPandas(processor, schema, "Update", "None")


def streaming_arms(log: DataFrame) -> DataFrame:
    """(arm, pulls, value) after each micro-batch of a stream (arm, t, reward)."""
    return _stateful(log, ArmProcessor(), "arm string, pulls long, value double")


def streaming_recent(log: DataFrame, keep: int = 200) -> DataFrame:
    """(arm, held, mean, last): the last `keep` rewards of each arm after each micro-batch, and the t of the latest."""
    return _stateful(log, ReplayProcessor(keep), "arm string, held int, mean double, last long")
