"""Principal components as a model, and domains by dissimilarity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import cleaning, neighbours, trees
from lattica.plans import applicability, dataset


def test_principal_components_are_a_model(spark, tmp_path):
    r = np.random.default_rng(1)
    latent = r.normal(0, 1, (200, 2))
    x = latent @ np.array([[2.0, 1.0, 0.5, -1.0], [0.0, 1.0, -1.0, 0.5]]) + r.normal(0, 0.02, (200, 4))
    holes = r.random((200, 4)) < 0.1
    names = ["a", "b", "c", "d"]
    rows = [(i, *[None if h else float(v) for v, h in zip(row, hole, strict=True)]) for i, (row, hole) in enumerate(zip(x, holes, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    model = cleaning.fit_ppca(df, names, 2)
    assert model.explained[-1] > 0.99 and (np.diff(model.explained) >= 0).all() and np.allclose(model.axes.T @ model.axes, np.eye(2))
    filled = {t.id: t for t in model.impute(df, "id").collect()}
    gaps = [(i, j) for i, j in zip(*np.nonzero(holes), strict=True) if holes[i].sum() <= 2]
    assert np.sqrt(np.mean([(filled[i][names[j]] - x[i, j]) ** 2 for i, j in gaps])) < 0.2
    places = {t.id: np.array(t.components) for t in model.transform(df, "id").collect()}
    whole = [i for i in range(200) if not holes[i].any()]
    z = (x[whole] - model.mean) / model.scale
    assert np.allclose([places[i] for i in whole], z @ model.axes)
    model.save(spark, str(tmp_path / "model"))
    again = cleaning.PPCA.load(spark, str(tmp_path / "model"))
    assert again.columns == names and np.allclose(again.loadings, model.loadings) and np.allclose(again.explained, model.explained)
    assert cleaning.fit_ppca(df.select("id", F.lit(None).cast("double").alias("a")), ["a"]) is None


def test_far_rows_are_outside(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, (240, 2)), r.normal(7, 0.6, (60, 2))])
    y = np.where(x[:, 0] < 4, np.sin(2 * x[:, 0]), 30 + 9 * x[:, 1])
    rows = [(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    data = dataset.load(df, "id", features=["a", "b"], target="y")
    fitted = applicability.fit(data, k=2, n_clusters=(2,), bandwidth=0.5, n_trees=3, depth=3, bins=4, most_rmse=0.5, most_area=0.5)
    new = spark.createDataFrame([(1, 0.0, 0.1), (2, 60.0, -60.0), (3, None, 1.0)], "id long, a double, b double")
    got = {t.id: t for t in fitted.predict(new).collect()}
    assert set(got) == {1, 2} and got[2].dissimilarity == pytest.approx(1.0) and got[1].dissimilarity < 0.7
    assert got[1].domain_residual == 1 and got[2].domain_residual == -1
    bins = fitted.bins.orderBy("bin").collect()
    assert sum(b.n for b in bins) == 600 and all(b.inside_error in (0, 1) for b in bins)


def test_densities_are_of_places(spark, monkeypatch):
    """Densities of training rows among themselves grow with the distinct rows of the features and not with the square of the table."""
    sizes, build = [], neighbours.build
    monkeypatch.setattr(neighbours, "build", lambda train, *a, **k: (sizes.append(train.count()), build(train, *a, **k))[1])
    df = spark.range(900).select("id", (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 10).alias("y"))
    data = dataset.load(df, "id", features=["a", "b"], target="y")
    fitted = applicability.fit(data, k=2, n_clusters=(2,), n_trees=2, depth=2, bins=2)
    assert fitted.predict(df).count() == 900 and sizes and max(sizes) <= 20


def test_folds_share_their_scans(spark, monkeypatch):
    """Kernels between places are measured once for all folds, and their forests grow in the same scans."""
    built, grown, build, histograms = [], [], neighbours.build, trees._histograms
    monkeypatch.setattr(neighbours, "build", lambda *a, **k: (built.append(1), build(*a, **k))[1])
    monkeypatch.setattr(trees, "_histograms", lambda *a, **k: (grown.append(1), histograms(*a, **k))[1])
    df = spark.range(300).select("id", (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 10).alias("y"))
    applicability.fit(dataset.load(df, "id", features=["a", "b"], target="y"), k=3, n_clusters=(2,), n_trees=2, depth=2, bins=2)
    assert len(built) == 1 and len(grown) == 2
