"""Low-rank kernel models against exact solves in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import kernels


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    x = r.uniform(-2, 2, (300, 2))
    y = np.sin(2 * x[:, 0]) + 0.3 * x[:, 1] + r.normal(0, 0.1, 300)
    rows = [(i, float(a), float(b), float(t), i % 3) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    rows += [(1000, None, 0.0, 1.0, 0), (1001, 0.0, float("nan"), 1.0, 1)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, fold int").repartition(4), x, y


def exact(kernel, alpha, x, y, z, length=1.0):
    k = kernels.Kernel(kernel, length)
    cov = k.cross(x, x) + np.diag(k.noise(x) + alpha)
    mean, cross = y.mean(), k.cross(z, x)
    variance = k.diagonal(z) - np.einsum("ij,ji->i", cross, np.linalg.solve(cov, cross.T))
    c = y - mean
    likelihood = -0.5 * c @ np.linalg.solve(cov, c) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * len(y) * np.log(2 * np.pi)
    return cross @ np.linalg.solve(cov, c) + mean, np.sqrt(np.maximum(variance, 0)), likelihood


@pytest.mark.parametrize(("kernel", "alpha"), [("RBF", 0.1), ("ConstantKernel*RBF+WhiteKernel", 1e-10), ("Matern+WhiteKernel", 1e-6), ("RationalQuadratic*DotProduct+WhiteKernel", 0.01), ("DotProduct*WhiteKernel+RBF", 0.05), ("ExpSineSquared", 0.5)])
def test_all_landmarks_give_the_exact_solution(data, kernel, alpha):
    df, x, y = data
    names = ["a"] if kernel == "ExpSineSquared" else ["a", "b"]  # positive definite for one feature only
    x = x[:, : len(names)]
    df = df.where("id < 1000") if kernel == "ExpSineSquared" else df
    got = {r.id: r for r in kernels.cross_validated(df, "id", names, "y", "fold", kernel, alpha, 400).collect()}
    assert set(got) == set(range(300))
    for f in range(3):
        test = np.arange(300) % 3 == f
        mean, deviation, _ = exact(kernel, alpha, x[~test], y[~test], x[test])
        ids = np.flatnonzero(test)
        assert np.allclose([got[i].y_pred for i in ids], mean, atol=1e-5)
        assert np.allclose([got[i].y_err for i in ids], deviation, atol=1e-4)


def test_low_rank_is_close(data):
    """80 landmarks of 300 rows: within a hundredth of the target's deviation of the exact solution."""
    df, x, y = data
    got = {r.id: r for r in kernels.kernel_ridge(df, "id", ["a", "b"], "y", "fold", 0.5, 0.1, 80).collect()}
    for f in range(3):
        test = np.arange(300) % 3 == f
        mean, deviation, _ = exact("RBF", 0.1, x[~test], y[~test], x[test])
        ids = np.flatnonzero(test)
        assert np.abs(np.array([got[i].y_pred for i in ids]) - mean).max() < 0.01 * y.std()
        assert np.abs(np.array([got[i].y_err for i in ids]) - deviation).max() < 0.01


def test_likeliest_length(data):
    df, x, y = data
    lengths = (0.1, 0.7, 5.0)
    model = kernels.fit(df, ["a", "b"], "y", "RBF", 0.01, 400, lengths)
    want = {length: exact("RBF", 0.01, x, y, x[:1], length)[2] for length in lengths}
    assert model.features.kernel.length == max(want, key=want.get)
    assert model.log_likelihood == pytest.approx(max(want.values()), abs=1e-3)


def test_kernel_strings():
    k = kernels.Kernel("RBF + ConstantKernel * ConstantKernel")
    a = np.array([[0.0], [1.0]])
    assert np.allclose(k.cross(a, a), kernels.KERNELS["RBF"](a, a) + 1)  # from left to right
    with pytest.warns(UserWarning):
        assert kernels.Kernel("RBF-DotProduct").more == []
    with pytest.raises(ValueError):
        kernels.Kernel("Nothing")


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, a double, y double, fold int")
    assert kernels.cross_validated(none, "id", ["a"], "y", "fold").collect() == []
    with pytest.raises(ValueError):
        kernels.fit(none, ["a"], "y")


def test_few_places_are_worked_on_once(spark, monkeypatch):
    """20,000 rows in 30 places: sums and predictions are those of the places, and equal those of all rows."""
    df = spark.range(20_000).select("id", (F.col("id") % 6 / 2).alias("a"), (F.col("id") % 5 * 1.0).alias("b"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("y"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).cast("int").alias("fold"))
    df = df.withColumn("y", F.when(F.col("id") % 97 != 0, F.col("y"))).withColumn("a", F.when(F.col("id") % 89 != 0, F.col("a"))).withColumn("fold", F.when(F.col("id") % 83 != 0, F.col("fold")))
    seen, whole = spark.sparkContext.accumulator(0), kernels.Features.__call__

    def counted(self, x):
        seen.add(len(x))
        return whole(self, x)

    run = lambda: {r.id: r for r in kernels.cross_validated(df, "id", ["a", "b"], "y", "fold", "RBF+WhiteKernel", most=20).collect()}
    monkeypatch.setattr(kernels.Features, "__call__", counted)
    few = run()
    assert 0 < seen.value <= 30 * 3 * 2
    monkeypatch.setattr(kernels.Features, "__call__", whole)
    monkeypatch.setattr(kernels, "PLACES", 0)
    every = run()
    assert few.keys() == every.keys() and len(few) == df.where("a is not null").count()
    for k, r in every.items():
        got = few[k]
        assert got.fold == r.fold and (got.y_pred is None) == (r.y_pred is None) == (r.fold is None)
        assert r.y_pred is None or (abs(got.y_pred - r.y_pred) < 1e-9 and abs(got.y_err - r.y_err) < 1e-9)
