"""Model queries take every row of their tables, whatever its id."""

import numpy as np
import pytest

from quarry.operators.models import kernels
from quarry.plans import model_queries, pipelines
from quarry.plans.registry import QUERIES


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Embeddings whose ids lie beyond any prefix, in four classes."""
    rng, where = np.random.default_rng(1), str(tmp_path_factory.mktemp("late"))
    rows = [(5000 + k, [float(v) for v in rng.normal(size=64) + 3 * (k % 4 == 1)], k % 4) for k in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{where}/embeddings.parquet")
    return where


@pytest.mark.parametrize("name", ["perceptron", "svm_dual", "kernel_svm", "rff_svm"])
def test_two_class_models_take_all_rows(spark, late, name):
    assert QUERIES[name](spark, late).first()["n"] == 40


def test_network_takes_all_rows(spark, late):
    assert {r["row_id"] for r in QUERIES["network_training"](spark, late).collect()} == set(range(5000, 5080))


def test_classification_takes_all_rows(spark, late, monkeypatch):
    monkeypatch.setattr(model_queries, "classification_scores", lambda data: data)
    assert QUERIES["classification_pipeline"](spark, late).count() == 40


def test_fourier_machine_has_no_bound(spark, late, monkeypatch):
    monkeypatch.setattr(kernels, "training_rows", lambda df: pytest.fail("a variable for each row"))
    assert QUERIES["rff_svm"](spark, late).first()["n"] == 40


def test_dual_machine_beyond_the_former_bound(spark):
    """Rows that overlap, in several partitions: as many as there are, and no step from the solution lowers the primal objective."""
    rng = np.random.default_rng(3)
    y = np.where(np.arange(5200) % 2, 1.0, -1.0)
    x = rng.normal(size=(5200, 3)) + 0.6 * y[:, None]
    df = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "row_id long, x array<double>, y double").repartition(3)
    model = kernels.fit_svm_dual(df, 0.5)
    objective = lambda w, b: w @ w / 2 + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    least = objective(model.w, model.b)
    for size in (1e-4, 1e-2, 1.0):
        for step in rng.normal(size=(200, 4)):
            assert objective(model.w + size * step[:3], model.b + size * step[3]) >= least * (1 - 1e-7)
    assert kernels.fit_svm_dual(df.filter("y > 0")).b == 0.0


def test_classification_beyond_the_former_bound(spark):
    """A training set of over 5,000 rows; two classes that all six models tell apart."""
    rng = np.random.default_rng(4)
    y = np.arange(6500) % 2
    x = rng.normal(size=(6500, 3)) + 4.0 * y[:, None]
    df = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "row_id long, x array<double>, y double")
    found = {r["model"]: r["accuracy"] for r in pipelines.classification_scores(df).collect()}
    assert len(found) == 6 and all(a > 0.95 for name, a in found.items() if name != "linear") and found["linear"] < 0.05


def test_kernel_machine_beyond_the_former_bound(spark, monkeypatch):
    """Many blocks, some cut from one partition, training rows sent in groups: the decisions of the whole kernel matrix."""
    monkeypatch.setattr(kernels, "BLOCK_ROWS", 600)
    monkeypatch.setattr(kernels, "SENT_BYTES", 5 * 600 * 4 * 8)
    rng = np.random.default_rng(5)
    y = np.where(np.arange(5100) % 2, 1.0, -1.0)
    x = rng.normal(size=(5100, 3)) + 0.6 * y[:, None]
    df = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "row_id long, x array<double>, y double").repartition(3)
    got = kernels.fit_kernel_svm(df, "rbf", 0.5, 1.0, 1e-4, 3).decision(df.select("row_id", "x")).orderBy("row_id").collect()
    k, alpha, b = kernels.kernel_matrix("rbf", x, x, 0.5), np.ones(5100), 1.0
    for _ in range(3):
        share = (y * (k @ alpha + b) < 1) * y
        alpha, b = alpha - 1e-4 * (k @ alpha - k @ share), b + 1e-4 * share.sum()
    assert [r["row_id"] for r in got] == list(range(5100)) and np.allclose([r["decision"] for r in got], k @ alpha + b, atol=1e-8)
