"""Block products, tall QR, sketches and counter-based random numbers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import random as rnd
from quarry.operators import sketches
from quarry.operators.blocks import block_matmul, tall_qr, triangle
from quarry.plans import operator_queries

LONG = "i long, j long, v double"


@pytest.mark.parametrize(("size", "inner"), [(256, 4096), (3, 5), (7, 2)])
def test_block_products(spark, size, inner):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-4, 5, (17, 23)) * (rng.random((17, 23)) < 0.4), rng.integers(-4, 5, (23, 11)) * (rng.random((23, 11)) < 0.5)
    cells = lambda m: [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    x, y = cells(a), cells(b)
    twice, absent = [(0, 0, 1.5), (0, 0, 2.5)], [(2, 3, None)]
    a[0, 0] += 4
    got = block_matmul(spark.createDataFrame(x + twice + absent, LONG), spark.createDataFrame(y, LONG), size, inner)
    found = np.zeros((17, 11))
    for r in got.collect():
        found[r["i"], r["j"]] += r["v"]
    assert (found == a @ b).all()
    assert block_matmul(spark.createDataFrame(x, LONG), spark.createDataFrame([], LONG), size, inner).count() == 0


def test_tall_qr(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6)) * 10.0 ** -np.arange(0, 12, 2)  # badly conditioned
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>").repartition(40)
    q, upper = tall_qr(df)
    rows = {r["row_id"]: r["x"] for r in q.collect()}
    got = np.array([rows[i] for i in range(500)])
    assert np.abs(got.T @ got - np.eye(6)).max() < 1e-12 and (np.diag(upper) > 0).all() and np.allclose(upper, np.triu(upper))
    assert np.abs(got @ upper - x).max() < 1e-12
    assert np.allclose(triangle(df), np.linalg.cholesky(x.T @ x).T, rtol=1e-6, atol=1e-12)
    few = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert triangle(few.limit(0)).shape == (0, 0)
    with pytest.raises(ValueError):
        tall_qr(few)
    with pytest.raises(ValueError):
        tall_qr(spark.createDataFrame([([1.0, 2.0],), ([2.0, 4.0],), ([3.0, 6.0],)], "x array<double>"))


def test_sketches_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 40).alias("day"), (F.col("id") % 9000).alias("user"), F.col("id").cast("double").alias("value"), F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("x"), F.col("id") % 500)).alias("item"))
    parts = sketches.sketched(df, ["day"], "user", "value", "item")
    one = sketches.read(sketches.merged(parts.withColumn("all", F.lit(1)), ["all"]), [0.25, 0.75], 1).first()
    assert one["n"] == 40_000 and abs(one["distinct"] - 9000) <= 9000 * sketches.DISTINCT_ERROR
    assert all(abs(v / 40_000 - q) <= sketches.RANK_ERROR for v, q in zip(one["quantiles"], (0.25, 0.75)))
    assert one["top"][0]["item"] == "often" and abs(one["top"][0]["count"] - 13_334) <= 40_000 * 3.5 / sketches.MAX_ITEMS
    nulls = spark.createDataFrame([(1, None, None, None)], "day int, user long, value double, item string")
    assert sketches.read(sketches.merged(sketches.sketched(nulls, ["day"], "user", "value", "item"), ["day"]), [0.5], 1).first()["distinct"] == 0


def test_sketches_without_a_frequent_item(spark, tmp_path):
    """More users than a sketch tells apart, none of whom stands out: the list of frequent ones is empty, the query's bounds hold."""
    events = spark.range(30_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 5 * 86400).alias("ts"), (F.col("id") % 15_000).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 997).cast("double").alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in operator_queries.sketches_by_day(spark, str(tmp_path)).collect()] == [("view", 30_000, True, True, True, 15_000)]


def plain(counter, seed, stream):
    x = ((counter & rnd.PRIME) + (seed * 7919 + stream * 104729 + 12345) % rnd.PRIME) % rnd.PRIME
    for m in rnd.ROUNDS:
        x = ((x + 1) * m + ((counter & ((1 << 62) - 1)) >> 31)) % rnd.PRIME
        x = (x ^ (x >> 15)) % rnd.PRIME
    return x


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20), st.integers(0, 10**6), st.integers(0, 50))
def test_draws_are_the_stated_arithmetic(spark, counters, seed, stream):
    got = spark.createDataFrame([(c,) for c in counters], "c long").select(rnd.draw(F.col("c"), seed, stream)).collect()
    assert [r[0] for r in got] == [plain(c, seed, stream) for c in counters]


def test_draws_look_random(spark):
    df = spark.range(100_000).repartition(3).select("id", rnd.uniform(F.col("id"), 1).alias("u"), rnd.uniform(F.col("id"), 2).alias("w"), rnd.normal(F.col("id"), 1).alias("g"), rnd.discrete(F.col("id"), [1.0, 0.0, 3.0], 4).alias("k"))
    t = df.toPandas().sort_values("id")
    u, w, g = (t[c].to_numpy() for c in "uwg")
    counts = np.histogram(u, 100, (0, 1))[0]
    assert 0 < u.min() and u.max() < 1 and ((counts - 1000) ** 2 / 1000).sum() < 160  # 99 degrees of freedom
    pairs = np.histogram2d(u[:-1], u[1:], 10, [(0, 1)] * 2)[0]
    assert ((pairs - 999.99) ** 2 / 999.99).sum() < 160
    assert abs(np.corrcoef(u, w)[0, 1]) < 0.015 and abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.015
    assert abs(g.mean()) < 0.02 and abs(g.std() - 1) < 0.02 and abs((g**4).mean() - 3) < 0.15
    assert abs((t.k == 0).mean() - 0.25) < 0.01 and not (t.k == 1).any()
    assert spark.sql("select cast(null as long) c").select(rnd.uniform(F.col("c"), 1), rnd.discrete(F.col("c"), [1.0], 1)).first()[:] == (None, None)
    with pytest.raises(ValueError):
        rnd.discrete(F.col("id"), [0.0], 1)
