"""Small literal fixtures with known results, solver optima, differential and invariance tests."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry import estimators
from quarry.functions import arrays, ieee, text
from quarry.operators import bandit, frame, linalg, rl, split, stats, symbolic
from quarry.operators.augment import FourierFeatures, augment
from quarry.operators.models import bayes, components, kernels, linear, neighbors
from quarry.operators.nn import Activation, Dense, Sequential, network_gradient, network_scores, train_network
from quarry.operators.optim import KINDS, Optimizer, solve_linear, solve_quadratic
from quarry.sources import readers, sinks


def rows(spark, xs, ys=None):
    ys = ys or [0.0] * len(xs)
    return spark.createDataFrame([(i, [float(v) for v in x], float(y)) for i, (x, y) in enumerate(zip(xs, ys, strict=True))], "row_id long, x array<double>, y double")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_ieee(spark):
    d = lambda v: F.lit(float(v))
    assert one(spark, ieee.ieee_log(d(0))) == -math.inf and math.isnan(one(spark, ieee.ieee_log(d(-1)))) and one(spark, ieee.ieee_log(d(1))) == 0
    assert one(spark, ieee.ieee_div(d(1), d(0))) == math.inf and one(spark, ieee.ieee_div(d(-1), d(0))) == -math.inf and math.isnan(one(spark, ieee.ieee_div(d(0), d(0))))
    assert one(spark, ieee.sign(d(0), -1)) == -1 and one(spark, ieee.sign(d(0), 1)) == 1
    assert one(spark, ieee.clamp(d(7), 0, 5)) == 5


def test_kernels(spark):
    a, b = (1.5, -2, 0.5), (0.25, 3, -1)
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    dot = float(np.dot(a, b))
    want = {"linear": dot, "poly2": (1 + dot) ** 2, "poly3": (1 + dot) ** 3, "rbf": math.exp(-0.7 * float(((np.array(a) - b) ** 2).sum()))}
    for name, v in want.items():
        for d in (3, None):
            assert one(spark, arrays.kernel(name, lit(a), lit(b), 0.7, d)) == pytest.approx(v, abs=1e-12)
    with pytest.raises(ValueError):
        arrays.kernel("cubic", lit(a), lit(b))
    masked = one(spark, arrays.softmax(lit((1.0, -1e9, 3.0))))
    assert masked[1] == 0 and sum(masked) == pytest.approx(1)


def test_cells_with_all(spark, monkeypatch):
    """Several blocks of queries, cells in small pieces, a null vector, vectors whose products would cancel; no join."""
    rng = np.random.default_rng(4)
    vectors = [*rng.normal(size=(40, 3)).tolist(), None, [1e7, 1e7, 1e7], [1e7, 1e7, 1e7 + 0.5]]
    df = spark.createDataFrame(list(enumerate(vectors)), "row_id long, x array<double>").repartition(3)
    monkeypatch.setattr(linalg, "QUERY_BYTES", 400)
    monkeypatch.setattr(linalg, "PIECE_CELLS", 7)
    for name, f in (("linear", lambda a, b: a @ b), ("rbf", lambda a, b: math.exp(-0.7 * float(((a - b) ** 2).sum()))), ("poly3", lambda a, b: (1 + a @ b) ** 3)):
        asked = df.filter("row_id % 2 = 0")
        cells = linalg.cells_with_all(asked, df, lambda a, b, n=name: kernels.kernel_matrix(n, a, b, 0.7), 6)
        assert "Join" not in cells._jdf.queryExecution().executedPlan().toString()
        got = {(r["i"], r["j"]): r["v"] for r in cells.collect()}
        assert len(got) == 22 * 43
        for (i, j), v in got.items():
            if vectors[i] is None or vectors[j] is None:
                assert v is None
            else:
                assert v == pytest.approx(f(np.array(vectors[i]), np.array(vectors[j])), rel=1e-12, abs=6e-7)
    assert linalg.cells_with_all(df.limit(0), df, lambda a, b: a @ b.T, 6).count() == 0
    v = np.array([0.0000005, -0.0000005, 2.5e-6, -1e-9, 1e308, np.inf, 0.12345649999999])
    assert repr(linalg.rounded(v, 6).tolist()) == "[1e-06, -1e-06, 3e-06, 0.0, 1e+308, inf, 0.123456]"


def test_cells_by_value(spark, monkeypatch, tmp_path):
    """Cells of a task stand ordered by value and take less disk than 8 bytes a value; the grid is whole, also in shares of queries, whose rows are dealt once."""
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    x = np.random.default_rng(7).normal(size=(2400, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "row_id long, x array<double>")
    f = lambda a, b: kernels.kernel_matrix("rbf", a, b, 0.7)
    linalg.cells_with_all(df, df, f, 6).write.parquet(str(tmp_path / "cells"))
    files = list((tmp_path / "cells").glob("*.parquet"))
    assert sum(p.stat().st_size for p in files) < 6 * 2400 * 2400
    got, i, j = np.full((2400, 2400), np.nan), *(np.concatenate([pq.read_table(p).column(c).to_numpy() for p in files]) for c in "ij")
    got[i, j] = np.concatenate([pq.read_table(p).column("v").to_numpy() for p in files])
    assert len(i) == 2400 * 2400 and np.abs(got - f(x, x)).max() < 5.1e-7

    monkeypatch.setattr(linalg, "QUERIES", 9)
    monkeypatch.setattr(linalg, "ORDERED_CELLS", 1)
    small = spark.createDataFrame([*enumerate(x[:20].tolist()), (20, None)], "row_id long, x array<double>")
    cells = linalg.cells_with_all(small, small, f, 6)
    rows = cells.withColumn("task", F.spark_partition_id()).collect()
    assert {(r["i"], r["j"]) for r in rows} == {(i, j) for i in range(21) for j in range(21)} and len(rows) == 21 * 21
    assert all((r["v"] is None) == (20 in (r["i"], r["j"])) for r in rows) and all(abs(r["v"] - f(x[[r["i"]]], x[[r["j"]]])[0, 0]) < 5.1e-7 for r in rows if r["v"] is not None)
    assert all(a["v"] <= b["v"] for a, b in zip(rows, rows[1:]) if a["task"] == b["task"] and None not in (a["v"], b["v"]))
    for v, places in (([[3e-6, np.nan], [-1.0, 1e300]], [(1, 0), (0, 0), (1, 1), (0, 1)]), ([[2.5, -1.0, 0.0]], [(0, 1), (0, 2), (0, 0)])):
        steps = list(linalg.by_value(np.array(v), 6, 2))
        assert [(j, i) for js, i_s, _ in steps for j, i in zip(js.tolist(), i_s.tolist(), strict=True)] == places
        assert np.array_equal(np.concatenate([x[2] for x in steps]), [v[j][i] for j, i in places], equal_nan=True)


def test_lexer():
    kinds = text.tokenize("exp(x) + max(1.25, _y2) - sigmoid(z) / min(abs(.5), log2)")
    assert len(kinds) == 27 and kinds[-1].kind == "end"
    assert [t.kind for t in kinds if t.text in ("exp", "log2", "_y2")] == ["keyword", "identifier", "identifier"]
    for bad in ("@", "1e+"):
        with pytest.raises(ValueError):
            text.tokenize(bad)


def test_matrices(spark):
    m = lambda v: frame.to_long(readers.literal(spark, v))
    get = lambda df: sorted((r["i"], r["j"], r["v"]) for r in df.collect())
    a, b = m([[1, 2], [3, 4]]), m([[5, 6], [7, 8]])
    assert get(linalg.add(a, b)) == [(0, 0, 6), (0, 1, 8), (1, 0, 10), (1, 1, 12)]
    assert get(linalg.matmul(a, b)) == [(0, 0, 19), (0, 1, 22), (1, 0, 43), (1, 1, 50)]
    assert get(linalg.transpose(a)) == [(0, 0, 1), (0, 1, 3), (1, 0, 2), (1, 1, 4)]
    assert not linalg.equal(a, b) and linalg.equal(a, a) and not linalg.equal(a, a.filter("i = 0"))
    assert linalg.identity(spark, 0).count() == 0 and linalg.zeros(spark, 5, 4).count() == 20 and linalg.zeros(spark, 0, 4).count() == 0
    with pytest.raises(ValueError):
        readers.literal(spark, [[1], [1, 2]])
    q, r = linalg.householder_qr(np.array([[1.0, 2], [3, 4], [5, 6]]))
    assert q.shape == (3, 3) and np.allclose(q @ r, [[1, 2], [3, 4], [5, 6]])
    values, vectors = linalg.eigen_by_qr(np.array([[2.0, 1], [1, 3]]))
    assert np.allclose(np.sort(values), np.linalg.eigvalsh([[2, 1], [1, 3]])) and np.allclose(vectors @ np.diag(values) @ vectors.T, [[2, 1], [1, 3]], atol=1e-6)


def test_partition_invariance(spark):
    rng = np.random.default_rng(1)
    df = rows(spark, rng.normal(size=(97, 5)).tolist())
    want = linalg.collect_small(linalg.gramian(df.coalesce(1)), 5, 5)
    assert np.allclose(linalg.collect_small(linalg.gramian(df.repartition(7)), 5, 5), want, atol=1e-9)
    x = np.array([r["x"] for r in df.collect()])
    assert np.allclose(want, x.T @ x)


def test_neighbors(spark, monkeypatch):
    train = rows(spark, [(0, 0), (10, 10), (1, 1)], [0, 1, 2])
    ask = rows(spark, [(0.1, 0.1), (9.5, 9.5)])
    assert sorted((r["query"], r["y"]) for r in neighbors.knn_predict(ask, train, 1).collect()) == [(0, 0.0), (1, 1.0)]
    tie = rows(spark, [(0, 0), (0, 0), (5, 5)], [1, 2, 3])
    assert [r["y"] for r in neighbors.knn_predict(rows(spark, [(0, 0)]), tie, 2).collect()] == [1.0]
    rng = np.random.default_rng(2)
    train, ask = rows(spark, rng.normal(size=(200, 4)).tolist(), rng.integers(0, 3, 200).tolist()), rows(spark, rng.normal(size=(30, 4)).tolist())
    got = lambda: sorted(map(tuple, neighbors.nearest(ask, train, 7).collect()))
    broadcast = got()
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(neighbors, "CELL_QUERIES", 11)
    assert got() == broadcast
    with pytest.raises(ValueError):
        neighbors.nearest(ask, train, 0)


def test_neighbors_tied(spark, monkeypatch):
    """More equal training rows than any margin of candidates, and near ties that a rough distance can't order."""
    n = 1000
    order = np.random.default_rng(3).permutation(n)
    train = spark.createDataFrame([(int(i), [1.0, 2.0], 0.0 if i < 5 else 1.0) for i in order], "row_id long, x array<double>, y double")
    ask = rows(spark, [(1.0, 2.5)])
    near = spark.createDataFrame([(i, [1e6, 1e-3 * (40 - i)], float(i)) for i in range(40)], "row_id long, x array<double>, y double")
    for limit in (neighbors.BROADCAST_BYTES, 0):
        monkeypatch.setattr(neighbors, "BROADCAST_BYTES", limit)
        assert sorted((r["rank"], r["neighbor"]) for r in neighbors.nearest(ask, train, 5).collect()) == [(k + 1, k) for k in range(5)]
        assert [r["y"] for r in neighbors.knn_predict(ask, train, 5).collect()] == [0.0]
        assert [r["neighbor"] for r in neighbors.nearest(rows(spark, [(1e6, 0.0)]), near, 3).orderBy("rank").collect()] == [39, 38, 37]


def test_gaussian_nb(spark):
    df = rows(spark, [(0, 0), (0.1, 0), (0.2, 0), (5, 5), (5.1, 5), (5.2, 5)], [0, 0, 0, 1, 1, 1])
    model = bayes.fit_gaussian_nb(df)
    ask = rows(spark, [(0, 0), (5, 5), (0.05, 0), (5.05, 5)], [0, 1, 0, 1])
    assert ask.agg(stats.accuracy(model.predict(F.col("x")), F.col("y"))).first()[0] == 1.0
    with pytest.raises(ValueError):
        bayes.fit_gaussian_nb(df.withColumn("y", F.col("y") * 2))


def test_kmeans(spark):
    df = rows(spark, [(0, 0), (9, 9), (0.2, 0.1), (9.1, 9.2), (0.1, 0), (9, 9.1)])
    found, centroids = neighbors.kmeans(df, 2)
    labels = [r["cluster"] for r in found.orderBy("row_id").collect()]
    assert labels[0] == labels[2] == labels[4] != labels[1] == labels[3] == labels[5]
    assert centroids.shape == (2, 2)
    assert {r["cluster"] for r in neighbors.kmeans(rows(spark, [(1, 1)] * 4), 2)[0].collect()} == {0}


def test_kmeans_of_equal_clusters(spark):
    """Clusters 0 and 2 start with equal rows in another order: their means are equal, the first takes all, the other stays empty as in SQL."""
    values = [0.1 * v + 900 for v in range(997)]
    data = [(2 * n, v) for n, v in enumerate(values + values[::-1])] + [(2 * n + 1, v + 50) for n, v in enumerate(values)]
    df = spark.createDataFrame([(4 * (n // 2) + (n % 2 if n % 2 else 0 if n // 2 < 997 else 2), [v]) for n, v in data], "row_id long, x array<double>").repartition(7)
    found, centroids = neighbors.kmeans(df, 4, 3, refill=False)
    assert {r["cluster"] for r in found.collect()} == {0, 1} and np.isinf(centroids[2:]).all()
    again, _ = neighbors.kmeans(df.repartition(3), 4, 3, refill=False)
    assert sorted(found.select("row_id", "cluster").collect()) == sorted(again.select("row_id", "cluster").collect())
    scattered = [(i, float(v)) for i, v in enumerate(np.random.default_rng(0).normal(size=500) * 1e3)]
    means = neighbors.cluster_means(spark.createDataFrame([(0, [v]) for _, v in scattered], "cluster int, x array<double>"), 1, 1, exponents=[13])
    assert means[0][0] == pytest.approx(math.fsum(v for _, v in scattered) / 500, rel=1e-14)


def test_pca(spark):
    raw = np.array([[((i + 1) * (j + 2) % 7) - 2.0 for j in range(3)] for i in range(20)])
    df = rows(spark, (raw - raw.mean(0)).tolist())
    basis, values = components.fit_pca(df, 2)
    assert basis.shape == (3, 2) and values[0] >= values[1]
    want = np.linalg.eigvalsh(np.cov(raw.T) + 1e-5 * np.eye(3))[::-1]
    assert np.allclose(values, want)
    for k in (0, 4):
        with pytest.raises(ValueError):
            components.fit_pca(df, k)
    with pytest.raises(ValueError):
        components.fit_pca(df.limit(1), 1)


def test_support_vectors(spark):
    df = rows(spark, [(2, 2), (2, 0), (0, 2), (0, 0)], [1, 1, -1, -1])
    square = rows(spark, [(2, 2), (2, 0), (0, 2), (0, 0)], [1, 1, -1, -1])
    model = kernels.fit_svm_dual(df, iterations=3000)
    assert square.agg(stats.accuracy(model.predict(F.col("x")), F.col("y"))).first()[0] == 1.0
    assert [r[0] for r in rows(spark, [(2, 1.5), (0.1, 0.2)]).select(model.predict(F.col("x"))).collect()] == [1, -1]
    ring = readers.circles(spark, 120)
    rbf = kernels.fit_kernel_svm(ring, "rbf", 0.5, 1.0, 0.01, 150)
    assert rbf.decision(ring).agg(F.avg(((F.col("decision") >= 0) == (F.col("y") > 0)).cast("double"))).first()[0] > 0.95
    fourier = kernels.fit_fourier_svm(ring, 64, 0.75, iterations=1500)
    assert fourier.predict(ring).agg(stats.accuracy(F.col("predicted").cast("double"), F.col("y"))).first()[0] > 0.9
    with pytest.raises(ValueError):
        kernels.fit_svm_dual(df.withColumn("y", F.lit(2.0)))


def test_linear_models(spark):
    df = rows(spark, [(0,), (1,), (2,), (3,)], [0, 1, 2, 3])
    model = linear.fit_linear(df, 0.1, 500)
    assert model.w[0] == pytest.approx(1, abs=1e-3) and model.b == pytest.approx(0, abs=5e-3)
    grid = readers.logistic_grid(spark)
    whole, parted = (linear.fit_logistic(d, Optimizer("gd", 0.15), 60, start=0.0) for d in (grid.coalesce(1), grid.repartition(5)))
    assert np.allclose(whole.w, parted.w, atol=1e-8) and whole.b == pytest.approx(parted.b, abs=1e-8)
    signed = grid.withColumn("y", F.col("y") * 2 - 1)
    perceptron = linear.fit_perceptron(signed, 300)
    assert signed.agg(stats.accuracy(perceptron.predict(F.col("x")).cast("double"), F.col("y"))).first()[0] > 0.9
    with pytest.raises(ValueError):
        linear.fit_logistic(df)


def test_augmentation(spark):
    df = rows(spark, [(1, -2), (0.5, 3)])
    for k in (2, 3, 4, 5):
        got = [r["x"] for r in augment(df, f"poly_{k}").orderBy("row_id").collect()]
        assert np.allclose(got, [[v**p for p in range(1, k + 1) for v in x] for x in ((1, -2), (0.5, 3))])
    features = FourierFeatures.draw(2, 16, 0.75)
    once, again = ([r["x"] for r in features(df).orderBy("row_id").collect()] for _ in range(2))
    assert np.allclose(once, again) and np.allclose(once, features.of(np.array([[1, -2], [0.5, 3]])))
    with pytest.raises(ValueError):
        augment(df, "poly_9")


def test_programs():
    s = solve_quadratic(np.diag([2.0, 2.0]), [-2, -4], [0, 0], [1, 1], [1, 1], 1.0)
    assert np.allclose(s.solution, [0, 1], atol=1e-3) and s.objective == pytest.approx(-3, abs=1e-3) and s.converged
    assert solve_quadratic([[1.0]], [0.0], [0.0], [1.0]).solution[0] == pytest.approx(0, abs=1e-5)
    best = solve_linear([3, 2], [[1, 1], [1, 0], [0, 1]], [4, 2, 3])
    assert np.allclose(best.solution, [2, 2]) and best.objective == pytest.approx(10)
    assert solve_linear([1], [[1]], [2], maximize=False).objective == 0
    assert solve_linear([1], [[-1]], [2]).unbounded
    for bad in (lambda: solve_linear([1], [[1]], [-1]), lambda: solve_quadratic([[1.0]], [0], [2], [1])):
        with pytest.raises(ValueError):
            bad()


def test_symbolic(spark):
    x, y = symbolic.var("x"), symbolic.var("y")
    f = x * x
    assert f.evaluate(x=3) == 9 and f.gradient(x=3)["x"] == pytest.approx(6, abs=1e-3) and f.forward("x").evaluate(x=3) == pytest.approx(6, abs=1e-3)
    g = symbolic.call("max", x, y) + symbolic.call("sigmoid", -x) / symbolic.call("log", y)
    assert g.variables() == ["x", "y"] and str(x + 1) == "(x + 1.000000)"
    assert one(spark, g.substitute(x=2.0, y=5.0).column()) == pytest.approx(g.evaluate(x=2.0, y=5.0))
    with pytest.raises(ValueError):
        f.evaluate(z=1)
    for kind, rate in (("gd", 0.1), ("adam", 0.1)):
        assert symbolic.optimize_expr((x - 4) ** 2 + 1, {"x": -3.0}, Optimizer(kind, rate), 500)["x"] == pytest.approx(4, abs=0.05)
    with pytest.raises(ValueError):
        symbolic.optimize_expr(f, {"x": 1.0}, Optimizer("sgd"), 1)


@pytest.mark.parametrize("kind", KINDS)
def test_optimizer_state(kind):
    a = Optimizer(kind, 0.1)
    theta = a.step(np.array([1.0, 2.0]), np.array([0.5, -1.0]))
    b = Optimizer.from_state(a.state())
    assert np.allclose(a.step(theta, np.ones(2)), b.step(theta, np.ones(2)))


def test_network(spark, tmp_path):
    net = Sequential([Dense(np.array([[0.2, -0.1], [0.4, 0.3], [-0.2, 0.5]]), np.array([0.1, -0.2, 0.05])), Activation("tanh"), Dense(np.array([[0.6, -0.4, 0.2]]), np.array([0.15]))])
    df = rows(spark, [(1, 0), (0.5, 1), (-1, 0.25), (0, 0.75)], [1, -0.5, 0.25, 2])
    serial, n = network_gradient(df.coalesce(1), net)
    spread, _ = network_gradient(df.repartition(4), net)
    assert n == 4 and np.allclose(serial, spread, atol=1e-9)
    x, y, h = np.array([r["x"] for r in df.orderBy("row_id").collect()]), np.array([1, -0.5, 0.25, 2]), 1e-6
    loss = lambda t: 0.5 * ((net.with_parameters(t)(x)[:, 0] - y) ** 2).sum()
    at = net.parameters()
    assert np.allclose(serial, [(loss(at + h * e) - loss(at - h * e)) / (2 * h) for e in np.eye(len(at))], atol=1e-5)
    single = Sequential([Dense(np.array([[2.0]]), np.array([0.5]))])
    assert single(np.array([[3.0]]))[0, 0] == 6.5 and single.with_parameters(np.array([2.0, 1.5]))(np.array([[3.0]]))[0, 0] == 7.5
    assert single.signature == "layers=1;params=2;Linear(1,1)"
    trained = train_network(df, net, Optimizer("adam", 0.05), 40)
    assert loss(trained.parameters()) < loss(at)
    assert network_scores(df, trained).count() == 4
    opt = Optimizer("adam", 0.01)
    opt.step(at, np.ones(len(at)))
    sinks.save_checkpoint(spark, net, opt, f"{tmp_path}/m")
    again, state = sinks.load_checkpoint(spark, f"{tmp_path}/m", net)
    assert np.array_equal(again.parameters(), at) and state.state() == opt.state()
    with pytest.raises(ValueError):
        sinks.load_network(spark, f"{tmp_path}/m.model", single)
    with pytest.raises(ValueError):
        Sequential([Activation("relu")])


def test_own_layer_and_loss(spark):
    """A layer and a loss that the engine doesn't know, against finite differences."""
    from quarry.operators.nn import Dense, Sequential, network_gradient, train_network
    from quarry.operators.optim import Optimizer

    class Softplus:
        __call__ = lambda self, x: np.log1p(np.exp(x))
        slope = lambda self, out: 1 - np.exp(-out)
        __str__ = lambda self: "Softplus"

    rng = np.random.Generator(np.random.PCG64(3))
    model = Sequential([Dense.xavier(2, 3, rng), Softplus(), Dense.xavier(3, 1, rng)])
    data, target = rng.normal(size=(40, 2)), rng.normal(size=40)
    df = spark.createDataFrame([(k, x.tolist(), float(t)) for k, (x, t) in enumerate(zip(data, target, strict=True))], "row_id long, x array<double>, y double")
    cost = lambda theta: float(np.logaddexp(0, np.abs(model.with_parameters(theta)(data)[:, 0] - target)).sum())
    slopes = lambda out, y: (np.sign(out[:, 0] - y) / (1 + np.exp(-np.abs(out[:, 0] - y))))[:, None]
    g, n = network_gradient(df, model, slopes)
    theta = model.parameters()
    steps = np.eye(len(theta)) * 1e-6
    assert n == 40 and model.signature.endswith("Linear(2,3)|Softplus|Linear(3,1)")
    assert g == pytest.approx([(cost(theta + s) - cost(theta - s)) / 2e-6 for s in steps], abs=1e-4)
    assert cost(train_network(df, model, Optimizer("adam", 0.05), 15, slopes).parameters()) < cost(theta)


def test_bandits():
    greedy = bandit.EpsilonGreedy(2, epsilon=0.0)
    greedy.update(0, 10), greedy.update(1, 20)
    assert {greedy.select() for _ in range(20)} == {1}
    ucb = bandit.UCB(3)
    first = []
    for _ in range(3):
        first.append(ucb.select())
        ucb.update(first[-1], 0.5)
    assert first == [0, 1, 2] and ucb.total == 3
    for bad in (lambda: bandit.EpsilonGreedy(0), lambda: bandit.EpsilonGreedy(2, epsilon=2)):
        with pytest.raises(ValueError):
            bad()
    session = bandit.recommend({0: np.eye(3), 1: -np.eye(3)}, np.ones(3), turns=50)
    assert len(session.rewards) == 6 and all(1 <= r <= 10 for r in session.rewards)
    rng, shelf, seen = np.random.Generator(np.random.PCG64(2)), bandit.Shelf(np.arange(12)[:, None], 12, 4), []
    for _ in range(4000):
        seen.append(int(shelf.draw(rng)[0]))
        assert len(set(seen[-5:])) == min(5, len(seen))  # none of the last four
    assert min(np.bincount(seen, minlength=12)) > 250  # and otherwise any item alike


def test_games(spark):
    env = rl.TicTacToe(3)
    for a in (0, 3, 1, 4):
        env.step(a)
    assert env.step(0)[1] == rl.INVALID and env.step(2)[1] == rl.WIN and env.winner == 1 and env.over
    env.reset()
    for a in (0, 1, 8, 4):
        env.step(a)
    assert env.step(7)[1] == rl.BLOCK
    memory = rl.ReplayMemory(3)
    for k in range(5):
        memory.add(rl.Sample(np.zeros(1), k, 0.0, np.zeros(1), False))
    assert len(memory) == 3 and {s.action for s in memory.sample(9)} == {2, 3, 4}
    assert np.allclose(rl.discounted(np.array([1.0, 0, 2]), 0.5), [1.5, 1, 2]) and np.allclose(rl.normalized(np.array([2.0, 2])), [2, 2])
    agent = rl.train_agent(rl.Config(episodes=80, batch_size=16))
    played = stats.outcome_counts(rl.evaluate_agent(spark, agent.policy, 300)).first()
    assert played["games"] == played["wins"] + played["losses"] + played["draws"] == 300 and played["win_rate"] > 0.4
    again = rl.evaluate_agent(spark, agent.policy, 300)
    assert stats.outcome_counts(again.repartition(3)).first() == played


def test_critic(spark):
    """Losses by hand, a critic that learns its targets, and a network of one's own."""
    net = Sequential([Dense(np.zeros((2, 4)), np.zeros(2))])
    agent = rl.Reinforce(net, Optimizer("sgd", 1e-12), 0.5, critic=Sequential([Dense(np.zeros((1, 4)), np.zeros(1))]), critic_optimizer=Optimizer("sgd", 0.5), normalize=False, subtract_baseline=True)
    both, one = np.array([True, True]), np.array([False, True])
    episode = [(np.array([1.0, 0, 0, 0]), 0, 1.0, both), (np.array([0, 1.0, 0, 0]), 1, 4.0, one)]
    agent.episodes = [list(episode), []]
    got = agent.update()
    assert got["steps"] == 2 and got["policy_loss"] == pytest.approx(3 * math.log(2) / 2) and got["critic_loss"] == (9 + 16) / 2 and got["entropy"] == pytest.approx(math.log(2) / 2)
    for _ in range(300):
        agent.critic_optimizer = Optimizer("sgd", 0.1)
        agent.episodes = [list(episode)]
        last = agent.update()
    assert last["critic_loss"] < 1e-6 and agent.update()["steps"] == 0
    steps = spark.createDataFrame([([0.5, 0.5], 0, 0.0, 3.0), ([0.0, 1.0], 1, 0.0, 4.0)], "p array<double>, action int, value double, target double")
    row = rl.policy_losses(steps).first()
    assert all(row[k] == pytest.approx(got[k]) for k in got)
    whole = rl.Reinforce(net, Optimizer("sgd", 0.1), 0.5, normalize=False, reward_to_go=False)
    assert whole.targets(episode).tolist() == [3.0, 3.0]
    with pytest.raises(ValueError):
        rl.Reinforce(net, Optimizer("sgd", 0.1), subtract_baseline=True)
    own = rl.train_agent(rl.Config(algorithm="reinforce", episodes=16, batch_size=8, critic=True, network=lambda i, o, seed: Sequential.build([i, 5, o], "tanh", seed)))
    assert own.policy.layers[0].w.shape == (5, 18) and own.critic.layers[-1].w.shape == (1, 5)


def test_move_quality_columns(spark):
    random = np.random.Generator(np.random.PCG64(5))
    boards = [(random.integers(0, 3, n * n).tolist(), int(random.integers(n * n)), n) for n in (3, 4) for _ in range(40)]
    for n in (3, 4):
        df = spark.createDataFrame([b[:2] for b in boards if b[2] == n], "board array<int>, cell int")
        for player in (1, 2):
            for row in df.withColumn("q", rl.move_quality(F.col("board"), F.col("cell"), player, n)).collect():
                env = rl.TicTacToe(n)
                env.board = np.array(row["board"])
                theirs, ours = env.board.copy(), env.board.copy()
                theirs[row["cell"]], ours[row["cell"]] = 3 - player, player
                env.board = ours
                assert row["q"] == pytest.approx(env.move_quality(row["cell"], player))


def test_kernel_loss():
    x, y = np.array([[0.0, 0], [1, 1], [1.3, 0.8]]), np.array([-1.0, 1, 1])
    loss, k = kernels.kernel_loss(x, y, "rbf", 0.7, 2.0), kernels.kernel_matrix("rbf", x, x, 0.7)
    a, b = np.array([0.3, -0.2, 0.5]), 0.1
    assert loss.variables() == ["a0", "a1", "a2", "b"]
    assert loss.evaluate(**{f"a{i}": v for i, v in enumerate(a)}, b=b) == pytest.approx(a @ k @ a / 2 + 2 * np.maximum(0, 1 - y * (k @ a + b)).sum())


def test_element_update(spark):
    df = rows(spark, [(1, 2, 3)])
    assert df.select(arrays.put(F.col("x"), 1, 9.0)).first()[0] == [1.0, 9.0, 3.0]
    for outside in (-1, 3):
        with pytest.raises(Exception, match="no element"):
            df.select(arrays.put(F.col("x"), outside, 9.0)).collect()


def test_estimators(spark):
    xs = [(0, 0), (1, 1), (1.3, 0.8), (-0.8, -0.7)]
    signed, binary = rows(spark, xs, [-1, 1, 1, -1]), rows(spark, xs, [0, 1, 1, 0])
    for model, df in [(estimators.KNN(1), binary), (estimators.LogisticRegression(iterations=200), binary), (estimators.GaussianNB(), binary), (estimators.Perceptron(20), signed), (estimators.SVM(iterations=500), signed),
                      (estimators.SVM(dual=True), signed), (estimators.KernelSVM(), signed), (estimators.FourierSVM(iterations=300), signed)]:
        with pytest.raises(ValueError):
            model.predict(df)
        assert model.fit(df).predict(df).count() == 4 and 0.5 <= model.score(df) <= 1
    assert 0 <= estimators.LinearRegression().fit(binary).score(binary) <= 1
    assert {c["predicted"] for c in estimators.KMeans(2).fit(binary).predict(binary).collect()} <= {0, 1}
    assert len(estimators.PCA(1).fit(binary).transform(binary).first()["x"]) == 1


def test_running_in_two_levels(spark):
    """As one window over the whole key gives it; a key with nearly all rows, nulls, ties in no order."""
    data = [("hot" if k % 9 else "cold", float((k * 37) % 101), None if k % 13 == 0 else float(k % 17 - 8)) for k in range(400)] + [(None, 5.0, 2.0), ("nulls", 1.0, None), ("hot", None, 100.0)]
    data = [(a, None if t is None else t + k / 1000, v) for k, (a, t, v) in enumerate(data)]
    got = stats.running(spark.createDataFrame(data, "arm string, t double, reward double"), "arm", "t", "reward").collect()
    assert len(got) == len(data) and set(got[0].asDict()) == {"arm", "t", "reward", "running_sum", "running_count", "running_max"}
    for row in got:
        seen = [v for a, t, v in data if a == row["arm"] and v is not None and (t is None or row["t"] is not None and t <= row["t"])]
        assert row["running_count"] == len(seen) and row["running_max"] == max(seen, default=None)
        assert (row["running_sum"] is None and not seen) or row["running_sum"] == pytest.approx(sum(seen))


def test_ranks_and_blocks(spark):
    """As windows over whole keys give them; a hot key, a value that most rows have, null keys, values and no rows."""
    data = [("hot" if k % 9 else None if k % 2 else "cold", (k * 37) % 1009, None if k % 13 == 0 else 7.0 if k % 3 else float(k % 5)) for k in range(500)] + [("nulls", 1, None), ("one", 2, 1.0)]
    df = spark.createDataFrame(data, "arm string, t long, reward double")
    got = {(x["arm"], x["t"]): x["place"] for x in stats.ranked(df, "arm", "reward", "t").collect()}
    blocks, w = stats.blocked(df, "arm", "t", 3, 1, block=8)
    near = blocks.withColumn("seen", F.collect_list(F.coalesce("reward", F.lit(-1.0))).over(w.rowsBetween(-3, 1))).filter("own").collect()
    assert len(got) == len(data) == len(near) and blocks.groupBy("arm", "_block").count().agg(F.max("count")).first()[0] <= 12
    for arm in {a for a, _, _ in data}:
        own = sorted((t, v) for a, t, v in data if a == arm)
        falling = sorted(own, key=lambda e: (e[1] is None, -(e[1] or 0), e[0]))
        assert [got[arm, t] for t, _ in falling] == list(range(1, len(own) + 1))
        seen = {x["t"]: (x["number"], x["seen"]) for x in near if x["arm"] == arm}
        for i, (t, _) in enumerate(own):
            assert seen[t] == (i + 1, [-1.0 if v is None else v for _, v in own[max(0, i - 3) : i + 2]])
    assert stats.ranked(df.limit(0), "arm", "reward", "t").count() == stats.blocked(df.limit(0), "arm", "t", 1, 1)[0].count() == 0
    with pytest.raises(ValueError):
        stats.blocked(df, "arm", "t", 9, 1, block=8)


def test_splits(spark):
    df = spark.range(1003).select(F.col("id").alias("row_id"))
    parts = split.exact_split(df, 0.8, "row_id", seed=3)
    assert parts.filter("is_train").count() == 802 and parts.count() == 1003
    assert split.minibatch(df, 10, "row_id", 1).count() == 10
    shard = split.equal_shard(rows(spark, [(r, r + 10) for r in range(6)], [r + 100 for r in range(6)]), 6, 1, 3)
    assert sorted((r["row_id"], r["y"]) for r in shard.collect()) == [(2, 102), (3, 103)]
    with pytest.raises(ValueError):
        split.equal_shard(df, 1003, 0, 2)
    drawn = split.minibatch(df, 300, "row_id", 1, replacement=True)
    assert drawn.count() == 300 and 200 < drawn.distinct().count() < 300
    assert split.minibatch(df.limit(0), 5, "row_id", 1, replacement=True).count() == 0
    for order in (F.col("row_id") % 10, F.concat(F.lit("k"), F.lpad((F.col("row_id") * 37 % 500).cast("string"), 4, "0")), F.when(F.col("row_id") > 20, F.col("row_id") / -3), F.lit(7).cast("int"), F.date_add(F.lit("2020-01-01"), (F.col("row_id") % 90).cast("int"))):
        got = split.exact_split(df.withColumn("o", order), 0.7, "row_id", order=F.col("o")).collect()
        first = sorted(got, key=lambda r: (r["o"] is not None, r["o"] if r["o"] is not None else 0, r["row_id"]))
        assert [r["is_train"] for r in first] == [True] * 702 + [False] * 301


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("# note\nb , a,c\r\n 1 ,x ,9\r\n300000000000, y,8\r\n\r\n")
    got = readers.read_csv(spark, str(p), {"a": "string", "b": "int"}, comment="#", overflow="clamp").orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in got] == [("x", 1), ("y", 2147483647)]
    assert [r["b"] for r in readers.read_csv(spark, str(p), {"b": "int"}, comment="#", overflow="null", skip_empty=False).collect()][:2] == [1, None]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(p), {"z": "int"}, comment="#")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(p), {"a": "string"}, comment="#", ignore_extra=False)
    assert readers.read_csv(spark, str(p), {"z": "int", "a": "string"}, comment="#", ignore_missing=True).first()["z"] is None
    (tmp_path / "best.model").write_text("m"), (tmp_path / "episode_40.model").write_text("m")
    assert sorted(r["episode"] for r in readers.checkpoints(spark, str(tmp_path)).collect()) == [-2, 40]
    sinks.save_network(spark, Sequential([Dense(np.eye(2), np.zeros(2))]), str(tmp_path / "episode_7.model"))
    (tmp_path / "deeper").mkdir(), (tmp_path / "deeper" / "episode_1.model").write_text("m")
    assert sinks.delete_checkpoints(spark, str(tmp_path)) == ["episode_40.model", "episode_7.model"]
    assert (tmp_path / "best.model").exists() and (tmp_path / "deeper" / "episode_1.model").exists() and not (tmp_path / "episode_7.model").exists()
