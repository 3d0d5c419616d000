"""Trees from histograms, their scores, jackknife and Shapley values against brute force in NumPy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import trees

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(5)
    x = np.column_stack([r.integers(0, 12, 200), r.integers(0, 5, 200), r.integers(0, 30, 200)]).astype(float)
    y = np.round(10 * np.sin(x[:, 0]) + 3 * x[:, 1] * (x[:, 2] > 14) + r.normal(0, 1, 200), 1)
    rows = [(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(5), x, y


def weights(spark, df, n):
    rows = df.select("id", trees.bags("id", n).alias("w")).orderBy("id").collect()
    return np.array([r.w for r in rows])


def brute(x, y, w, depth, least=1.0):
    """{node: (feature, cut)} and {node: value} by trying all cuts."""
    cuts, values, rows = {}, {}, {0: np.arange(len(x))}
    for node in range(2 ** (depth + 1) - 1):
        if node not in rows:
            continue
        own = rows[node]
        own_w = w[own]
        values[node] = (own_w * y[own]).sum() / own_w.sum()
        if node >= 2**depth - 1:
            continue
        best = None
        loss = lambda i: (w[i] * (y[i] - (w[i] * y[i]).sum() / w[i].sum()) ** 2).sum()
        for f in range(x.shape[1]):
            for c in np.unique(x[own[own_w > 0], f])[:-1]:
                left, right = own[x[own, f] <= c], own[x[own, f] > c]
                if w[left].sum() >= least and w[right].sum() >= least:
                    gain = loss(own) - loss(left) - loss(right)
                    if gain > 1e-7 and (best is None or gain > best[0] + 1e-7):
                        best = (gain, f, c, left, right)
        if best:
            cuts[node], rows[2 * node + 1], rows[2 * node + 2] = (best[1], best[2]), best[3], best[4]
    return cuts, values


def test_cuts_equal_brute_force(spark, data):
    df, x, y = data
    forest = trees.random_forest(df, "id", NAMES, "y", 3, 3, least=4.0)
    w = weights(spark, df, 3)
    for t, tree in enumerate(forest.trees):
        cuts, values = brute(x, y, w[:, t], 3, 4.0)
        assert {i: (tree.feature[i], tree.cut[i]) for i in np.flatnonzero(tree.feature >= 0)} == cuts
        assert all(tree.value[i] == pytest.approx(v) for i, v in values.items())


def test_scores_are_those_of_the_walk(data):
    df, x, y = data
    forest = trees.random_forest(df, "id", NAMES, "y", 6, 4, most_features=2)
    got = {r.id: r for r in trees.predict(df, forest).collect()}
    want = np.column_stack([t.value[t.nodes(x)] for t in forest.trees])
    assert np.allclose([got[i].learners for i in range(200)], want)
    assert np.allclose([got[i].y_pred for i in range(200)], want.mean(1)) and np.allclose([got[i].y_err for i in range(200)], want.std(1))
    assert np.corrcoef(want.mean(1), y)[0, 1] > 0.8
    assert "PythonUDF" not in trees.predict(df, forest)._jdf.queryExecution().executedPlan().toString()


def test_forest_is_kept_as_a_table(spark, data, tmp_path):
    df, x, _ = data
    forest = trees.random_forest(df, "id", NAMES, "y", 2, 3)
    forest.table(spark).write.parquet(str(tmp_path / "forest"))
    again = trees.Forest.from_table(spark.read.parquet(str(tmp_path / "forest")))
    assert again.features == NAMES and all((a.value[a.nodes(x)] == b.value[b.nodes(x)]).all() for a, b in zip(forest.trees, again.trees, strict=True))
    assert sum(again.importance().values()) == pytest.approx(1)


def test_many_values_are_binned(spark):
    df = spark.range(5000).select("id", (F.col("id") / 7).alias("a"), F.when(F.col("id") > 2500, 1.0).otherwise(0.0).alias("y"))
    forest = trees.random_forest(df, "id", ["a"], "y", 3, 2, bins=32)
    error = trees.predict(df, forest).agg(F.avg(F.pow(F.col("y") - F.col("y_pred"), 2))).first()[0]
    assert error < 0.25 / 16 and len(trees.bin_edges(df, ["a"], 32)[0]) == 32


def test_extra_trees(data):
    df, x, y = data
    a, b = (trees.extra_trees(df, "id", NAMES, "y", 8, 5, seed=s) for s in (1, 1))
    other = trees.extra_trees(df, "id", NAMES, "y", 8, 5, seed=2)
    assert all((p.cut == q.cut).all() and (p.feature == q.feature).all() for p, q in zip(a.trees, b.trees, strict=True))
    assert any((p.cut != q.cut).any() for p, q in zip(a.trees, other.trees, strict=True))
    mean = np.mean([t.value[t.nodes(x)] for t in a.trees], axis=0)
    assert np.corrcoef(mean, y)[0, 1] > 0.8
    for t in a.trees:  # every node has the mean of the rows that reach it
        at = t.nodes(x)
        assert all(t.value[k] == pytest.approx(y[at == k].mean()) for k in np.unique(at))
    assert len({t.cut[0] for t in a.trees}) > 1


def test_ada_boost(data):
    df, x, y = data
    forest = trees.ada_boost(df, "id", NAMES, "y", 4, 2)
    w = np.ones(len(x))
    for t in forest.trees:
        cuts, values = brute(x, y, w, 2, 1e-9)
        assert {i: (t.feature[i], t.cut[i]) for i in np.flatnonzero(t.feature >= 0)} == cuts
        error = np.abs(y - t.value[t.nodes(x)])
        loss = (w * error / error.max()).sum() / w.sum()
        assert t.largest == pytest.approx(error.max()) and t.weight == pytest.approx(math.log((1 - loss) / loss))
        w = w * (loss / (1 - loss)) ** (1 - error / error.max())
    learners = np.column_stack([t.value[t.nodes(x)] for t in forest.trees])
    heights = np.array([t.weight for t in forest.trees])
    want = []
    for row in learners:
        order = np.argsort(row, kind="stable")
        want.append(row[order][np.argmax(np.cumsum(heights[order]) >= heights.sum() / 2)])
    got = {r.id: r.y_pred for r in trees.predict(df, forest).collect()}
    assert np.allclose([got[i] for i in range(200)], want)


def test_boosting_ends_with_a_perfect_tree(spark):
    df = spark.createDataFrame([(i, float(i % 2), float(i % 2)) for i in range(20)], "id long, a double, y double")
    forest = trees.ada_boost(df, "id", ["a"], "y", 5, 2)
    assert len(forest.trees) == 1 and [r.y_pred for r in trees.predict(df, forest).orderBy("id").collect()] == [0.0, 1.0] * 10


def test_jackknife_equals_numpy(spark, data):
    df, x, _ = data
    forest = trees.random_forest(df, "id", NAMES, "y", 12, 3)
    w = weights(spark, df, 12)
    learners = np.column_stack([t.value[t.nodes(x)] for t in forest.trees])
    centred = learners - learners.mean(1, keepdims=True)
    covariances = centred @ (w - w.mean(1, keepdims=True)).T / 12  # test rows x training rows
    want = (covariances**2).sum(1)
    less = 200 / 144 * (centred**2).sum(1)
    products, n = trees.bag_products(df, "id", 12)
    assert n == 200
    for corrected, expected in ((False, want), (True, want - less)):
        got = {r.id: r.variance for r in trees.jackknife(trees.predict(df, forest), products, n, corrected).collect()}
        assert np.allclose([got[i] for i in range(200)], expected)


def expectation(tree, row, known, node=0):
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    if f in known:
        return expectation(tree, row, known, 2 * node + 1 + int(row[f] > tree.cut[node]))
    left, right = 2 * node + 1, 2 * node + 2
    return sum(tree.cover[k] / tree.cover[node] * expectation(tree, row, known, k) for k in (left, right))


def test_shapley_equals_all_subsets(data):
    df, x, _ = data
    forest = trees.random_forest(df, "id", NAMES, "y", 3, 3)
    got = {r.id: r for r in trees.shapley(df, forest, "id").where("id < 40").collect()}
    for i, row in enumerate(x[:40]):
        for f in range(3):
            want = 0.0
            for size in range(3):
                for s in itertools.combinations([g for g in range(3) if g != f], size):
                    share = math.factorial(size) * math.factorial(2 - size) / 6
                    want += share * np.mean([expectation(t, row, {*s, f}) - expectation(t, row, set(s)) for t in forest.trees])
            assert got[i].phi[f] == pytest.approx(want, abs=1e-9)
        assert got[i].base + sum(got[i].phi) == pytest.approx(np.mean([t.value[t.nodes(row[None])[0]] for t in forest.trees]))
    total = {r.feature: r.total for r in trees.shapley_importance(df, forest, "id").collect()}
    assert set(total) == set(NAMES) and min(total.values()) > 0


def test_missing_values(spark, data):
    df, x, _ = data
    holes = df.unionByName(spark.createDataFrame([(500, None, 1.0, 1.0, 1.0), (501, float("nan"), 1.0, 1.0, 1.0), (502, 1.0, 1.0, 1.0, None)], df.schema))
    forest = trees.random_forest(holes, "id", NAMES, "y", 2, 2)
    same = trees.random_forest(df, "id", NAMES, "y", 2, 2)
    assert all((a.cut == b.cut).all() for a, b in zip(forest.trees, same.trees, strict=True))
    got = {r.id: r.y_pred for r in trees.predict(holes.where("id >= 500"), forest).collect()}
    assert got[500] is None and got[501] is None and got[502] is not None
    with pytest.raises(ValueError):
        trees.random_forest(df, "id", NAMES, "y", 1000, 12)
