"""As-of and interval joins, scans, pivots and streams against brute force; hot keys, ties, nulls, several micro-batches."""

import math
import os
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators.models import neighbors
from quarry.operators.models.neighbors import _nearest, nearest_by_pivots
from quarry.operators.ranges import as_of, discounted_scan, fold_back, interval_join, interval_sums
from quarry.plans.operator_queries import stream_deduplicated, stream_recent
from quarry.plans.relational_queries import _event_stream, stream_arms, stream_closed_sessions, stream_join, stream_tumbling
from quarry.sources.readers import read_csv
from quarry.streaming import streams

from .conftest import SF


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_against_brute_force(spark, strict):
    rng = random.Random(strict)
    keys = ["hot"] * 8 + ["a", "b", None]
    left = [(i, rng.choice(keys), rng.choice([None, *range(40)]), "x") for i in range(400)] + [(5, "hot", 3, "x")] * 3
    right = [(rng.choice(keys), rng.choice([None, *range(0, 40, 3)]), i % 7, f"r{i}") for i in range(60)]
    l = spark.createDataFrame(left, "id long, k string, t long, _at string").repartition(7)
    got = as_of(l, spark.createDataFrame(right, "k string, t long, tie long, name string"), "k", "t", "tie", strict)
    best = lambda k, t: max(((rt, tie) for rk, rt, tie, _ in right if k is not None and t is not None and rk == k and rt is not None and (rt < t or not strict and rt == t)), default=None)
    found = sorted(((r["id"], r["k"], r["t"], r["_at"], (r["match"]["t"], r["match"]["tie"]) if r["match"] else None) for r in got.collect()), key=str)
    assert found == sorted(((i, k, t, x, best(k, t)) for i, k, t, x in left), key=str)
    assert as_of(l.limit(0), spark.createDataFrame(right, "k string, t long, tie long, name string"), "k", "t", "tie").count() == 0


def test_as_of_spreads_a_hot_key(spark):
    """Half of the rows of one key: no task of the ranges has it alone."""
    from quarry.operators.ranges import _dealt

    df = spark.range(20_000).select(F.when(F.col("id") < 10_000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be put together again
    tasks = _dealt(df, "k", "id").withColumn("task", F.spark_partition_id()).filter("k = 'hot'").groupBy("task").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 2 and max(r["count"] for r in tasks) < 8000


def test_interval_join_against_brute_force(spark):
    rng = random.Random(3)
    points = [(i, rng.choice([None, float("nan"), *[rng.uniform(-1e4, 1e4) for _ in range(6)]]), "k") for i in range(300)] + [(900, 5.0, "k"), (901, -7.0, "z")]
    bounds = [(a, a + w) for a, w in ((rng.uniform(-1e4, 1e4), rng.choice([0.0, 1e-9, 0.3, 7, 900, 3e4])) for _ in range(80))] + [(5.0, 5.0), (3.0, 1.0), (None, 2.0), (-1e4, 1e4)]
    p = spark.createDataFrame(points, "id long, v double, g string")
    i = spark.createDataFrame([(n, a, b, "k") for n, (a, b) in enumerate(bounds)], "n long, low double, high double, g string")
    want = sorted((x, n) for x, v, g in points for n, (a, b) in enumerate(bounds) if g == "k" and None not in (v, a, b) and a <= v <= b)
    assert sorted((r["id"], r["n"]) for r in interval_join(p, i, "v", "low", "high", ("g",)).collect()) == want
    assert interval_join(p, i.limit(0), "v", "low", "high", ("g",)).count() == 0


@pytest.mark.parametrize("size", [300, 0])
def test_interval_sums_against_the_join(spark, size):
    """Ties at both bounds, equal points over several tasks, keys of several intervals, narrow ones after great sums: as the join, and without its pairs."""
    rng = random.Random(5)
    points = [(rng.choice([None, float("nan"), float("inf"), 7.0, 7.0, rng.randrange(-50, 50) / 2, rng.uniform(-30, 30)]), round(rng.uniform(0, 1e10), 2)) for _ in range(size)] + [(29.5, 0.01)] * bool(size)
    bounds = [(n % 60, a, a + rng.choice([-1.0, 0.0, 0.5, 1e-9, 20.0, 1e6])) for n, a in enumerate(rng.randrange(-60, 60) / 2 for _ in range(90))] + [(None, 7.0, 7.0), (61, None, 3.0), (62, 29.25, 29.75), (63, float("-inf"), float("inf"))]
    p = spark.createDataFrame(points, "v double, m double").repartition(6)
    i = spark.createDataFrame(bounds, "k int, low double, high double")
    want = defaultdict(list)
    for k, a, b in bounds:
        want[k] += [round(m * 100) for v, m in points if v is not None and math.isfinite(v) and a is not None and a <= v <= b]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        found = interval_sums(p, i, "k", "v", "low", "high", "m")
        assert {r["k"]: (r["n"], round(r["total"] * 100)) for r in found.collect()} == {k: (len(m), sum(m)) for k, m in want.items() if m}
        with pytest.raises(Exception, match="below 2"):
            interval_sums(p.limit(0).unionAll(spark.createDataFrame([(1.0, 1e300)], p.schema)), i, "k", "v", "low", "high", "m")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("gamma", [0.9, 0.0, 1.0])
def test_returns_of_a_long_episode(spark, gamma):
    rng = random.Random(1)
    steps = [("long", t, rng.uniform(-1, 1), "z") for t in range(6000)] + [(e, t, None if t == 1 else 1.0, "z") for e in ("a", "b", None) for t in range(5)] + [("one", 0, 2.0, "z")]
    got = {(r["e"], r["t"]): (r["ret"], r["normalized"]) for r in discounted_scan(spark.createDataFrame(steps, "e string, t long, reward double, _task string").withColumnRenamed("_task", "own"), gamma, "e", "t", "reward").collect()}
    by = defaultdict(list)
    for e, t, r, _ in steps:
        by[e].append((t, r or 0.0))
    assert len(got) == len(steps)
    for e, rows in by.items():
        after, rets = 0.0, {}
        for t, r in sorted(rows, reverse=True):
            rets[t] = after = r + gamma * after
        v = np.array(list(rets.values()))
        for t, ret in rets.items():
            assert math.isclose(got[e, t][0], ret, rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(got[e, t][1], (ret - v.mean()) / v.std() if v.std() > 1e-8 else ret, rel_tol=1e-6, abs_tol=1e-6)


def test_fold_back():
    x = np.arange(1.0, 9.0)
    assert np.allclose(fold_back(x, 0.5, 4.0), [3.0, 3.5, 4.75, 6.375, 8.1875, 10.09375, 12.046875, 14.0234375])
    assert fold_back(np.zeros(0), 0.5).size == 0


@pytest.mark.parametrize(("pivots", "rows", "asked"), [(1, 10**6, 10**6), (8, 40, 30), (64, 7, 5)])
def test_pivots_against_all_pairs(spark, pivots, rows, asked):
    """Clustered points, a third of them copies of one: exact, ties by id, parts and groups cut small."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in (-4.0, 0.0, 5.0)] + [np.ones((90, 3))]).round(2)
    ids, y = np.arange(len(x)) * 3, rng.integers(0, 4, len(x)).astype(float)
    df = spark.createDataFrame([(int(i), v.tolist(), float(c)) for i, v, c in zip(ids, x, y)], "row_id long, x array<double>, y double").repartition(5)
    for k in (1, 4, 500):
        got = sorted(map(tuple, nearest_by_pivots(df, df, k, pivots, rows, asked).select("query", "rank", "neighbor", "y").collect()))
        place, _ = _nearest(x, x, ids, k)
        assert got == sorted((int(ids[q]), r + 1, int(ids[p]), float(y[p])) for q in range(len(x)) for r, p in enumerate(place[q]))


def test_tiles_where_pivots_tell_nothing_apart(spark, monkeypatch):
    """Unclustered vectors, copies among them: queries aren't sent to each cell, and tiles of several sizes find the same neighbours."""
    assert neighbors.tiling(600_000, 600_000, 100 * 600_000, 6) == (8, 8)  # 16 rows moved for each instead of 100
    assert neighbors.tiling(600_000, 600_000, 3 * 600_000, 6) is None
    monkeypatch.setattr(neighbors, "TILE_ROWS", 90)
    monkeypatch.setattr(neighbors, "PIVOT_ROWS", 4)
    cuts, tiling = [], neighbors.tiling
    monkeypatch.setattr(neighbors, "tiling", lambda *a: cuts.append(tiling(*a)) or cuts[-1])
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 24))
    x[200:230] = x[7]
    ids, y = np.arange(300) * 2, rng.integers(0, 4, 300).astype(float)
    df = spark.createDataFrame([(int(i), v.tolist(), float(c)) for i, v, c in zip(ids, x, y)], "row_id long, x array<double>, y double").repartition(5)
    for k in (1, 5, 400):
        got = sorted(map(tuple, nearest_by_pivots(df, df, k, 64).select("query", "rank", "neighbor", "y").collect()))
        place, _ = _nearest(x, x, ids, k)
        assert got == sorted((int(ids[q]), r + 1, int(ids[p]), float(y[p])) for q in range(300) for r, p in enumerate(place[q]))
    assert cuts[1] == (4, 4)


def test_csv_rows_stay(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("a,b\n1,x\n99999,y\n,z\n\n   \n,\n3,w\n")
    got = read_csv(spark, str(f), {"a": "smallint"}, overflow="null")
    assert [r["a"] for r in got.collect()] == [1, None, None, 3]
    assert [r["a"] for r in read_csv(spark, str(f), {"a": "smallint"}, overflow="null", skip_empty=False).collect()] == [1, None, None, None, 3]
    one = tmp_path / "b.csv"
    one.write_text("a\n7\n\nx\n")
    assert [r["a"] for r in read_csv(spark, str(one), {"a": "int"}, overflow="null").collect()] == [7, None]


@pytest.fixture(scope="module")
def event_folder(spark, tmp_path_factory):
    """The events as a folder of five files in order of time."""
    base = tmp_path_factory.mktemp("streams")
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(5, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/events.parquet")
    for k, f in enumerate(sorted((base / "events.parquet").glob("part-*"))):  # a stream takes files by their times
        os.utime(f, (1_600_000_000 + 60 * k,) * 2)
    return str(base)


@pytest.mark.parametrize("query", [stream_arms, stream_tumbling, stream_deduplicated, stream_recent, stream_join, stream_closed_sessions])
def test_streams_over_folders(spark, event_folder, query):
    assert sorted(map(str, query(spark, event_folder).collect())) == sorted(map(str, query(spark, SF).collect()))


def in_batches(spark, folder, tmp_path, make):
    """One file a micro-batch; files in order of time."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out, path = make(stream), f"{tmp_path}/out"
    spark.conf.set(*streams.STATE_STORE)
    mode = "update" if "held" in out.columns else "append"
    out.writeStream.foreachBatch(streams.batch_sink(path)).outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return streams.read_batches(spark, path, out.schema), path


def test_several_micro_batches(spark, event_folder, tmp_path):
    found, path = in_batches(spark, event_folder, tmp_path, lambda s: streams.closed_sessions(s.select("user_id", "ts"), 12 * 3_600_000))
    assert found.select("batch").distinct().count() > 2
    want = stream_closed_sessions(spark, SF)
    assert sorted(map(str, found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n").collect())) == sorted(map(str, want.collect()))
    # a batch that runs again writes the same folder anew
    before = sorted(map(str, found.collect()))
    again = found.filter("batch = 2").drop("batch").persist()
    again.count()
    streams.batch_sink(path)(again, 2)
    assert sorted(map(str, streams.read_batches(spark, path, again.schema).collect())) == before


def test_recent_over_micro_batches(spark, event_folder, tmp_path):
    log = lambda s: s.select(F.col("event_type").alias("arm"), F.col("event_id").alias("t"), F.col("value").alias("reward"))
    found, _ = in_batches(spark, event_folder, tmp_path, lambda s: streams.streaming_recent(log(s), 20))
    last = found.groupBy("arm").agg(F.max_by("mean", F.struct("last", "batch")).alias("mean")).collect()
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("event_id")
    for r in last:
        assert math.isclose(r["mean"], events[events.event_type == r["arm"]].value.tail(20).mean(), rel_tol=1e-9)


def test_outer_stream_join_drops_state(spark, event_folder, tmp_path):
    def make(s):
        side = lambda kind, name, ts: s.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("ts").alias(ts))
        return streams.interval_joined(side("click", "click", "clicked"), side("purchase", "purchase", "bought"), "user_id", "clicked", "bought", "6 hours", "0 seconds", "left_outer").select("click", "purchase", "clicked")

    found, _ = in_batches(spark, event_folder, tmp_path, make)
    rows = found.toPandas()
    e = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    pairs = e[e.event_type == "click"].merge(e[e.event_type == "purchase"], on="user_id")
    pairs = pairs[(pairs.ts_y >= pairs.ts_x) & (pairs.ts_y <= pairs.ts_x + pd.Timedelta(hours=6))]
    assert sorted(rows.dropna()[["click", "purchase"]].astype(int).itertuples(index=False, name=None)) == sorted(zip(pairs.event_id_x, pairs.event_id_y))
    alone = set(e[e.event_type == "click"].event_id) - set(pairs.event_id_x)
    seen = min(e[e.event_type == kind].ts.max() for kind in ("click", "purchase"))  # the watermark of the slower side
    ended = set(e[(e.event_type == "click") & (e.ts < seen - pd.Timedelta(hours=7))].event_id) & alone
    assert ended <= set(rows[rows.purchase.isna()].click) <= alone


def test_empty_streams(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    for query in (stream_arms, stream_tumbling, stream_deduplicated, stream_join):
        assert query(spark, str(tmp_path)).count() == 0
    assert _event_stream(spark, str(tmp_path)).isStreaming
