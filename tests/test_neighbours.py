"""The neighbour join and the kernel densities against all pairs, and their plans."""

import inspect
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import baselines, neighbours


def table(spark, x, start=0, y=True):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(start + i, *map(float, row), *([float(i % 7)] if y else [])) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, ["id", *names, *(["y"] if y else [])]), names


def brute(test, train, k, metric, same=False):
    a, b = test, train
    if metric in ("cosine", "correlation"):
        if metric == "correlation":
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        d = np.array([[1 - (x @ y) / ((np.linalg.norm(x) * np.linalg.norm(y)) or 1) for y in b] for x in a])
    else:
        gap = np.abs(a[:, None] - b[None])
        d = {"euclidean": lambda: np.sqrt((gap**2).sum(2)), "cityblock": lambda: gap.sum(2), "chebyshev": lambda: gap.max(2), "minkowski": lambda: (gap**3).sum(2) ** (1 / 3)}[metric]()
    d = np.round(d, 12)
    if same:
        np.fill_diagonal(d, np.inf)
    return [[(j, d[i, j]) for j in sorted(range(len(b)), key=lambda j: (d[i, j], j))[:k]] for i in range(len(a))]


@pytest.fixture(scope="module")
def clouds():
    r = np.random.default_rng(3)
    train = np.concatenate([r.normal(c, 0.2, (60, 5)) for c in (0.0, 3.0, 9.0)] + [np.full((40, 5), 3.0), np.zeros((3, 5)), np.round(r.normal(0, 2, (30, 5)))])
    test = np.concatenate([r.normal(c, 0.5, (12, 5)) for c in (0.0, 3.0, 6.0, 40.0)] + [np.full((2, 5), 3.0), np.zeros((2, 5))])
    return test, train


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "chebyshev", "minkowski", "cosine", "correlation"])
def test_nearest_equals_all_pairs(spark, clouds, metric, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    test, train = clouds
    a, names = table(spark, test, 1000, y=False)
    b, _ = table(spark, train)
    got = {}
    for r in neighbours.nearest(a, b, "id", names, "y", 4, metric).collect():
        got.setdefault(r.id - 1000, {})[r.place] = (r.neighbour, r.distance, r.y)
    for i, want in enumerate(brute(test, train, 4, metric)):
        assert [got[i][p][0] for p in range(4)] == [j for j, _ in want], (metric, i)
        assert np.allclose([got[i][p][1] for p in range(4)], [d for _, d in want], atol=1e-9)
        assert all(got[i][p][2] == got[i][p][0] % 7 for p in range(4))


def test_rows_are_not_their_own_neighbours(spark, clouds):
    _, train = clouds
    b, names = table(spark, train)
    got = {(r.id, r.place): r.neighbour for r in neighbours.nearest(b, b, "id", names, "y", 2, skip_self=True).collect()}
    for i, want in enumerate(brute(train, train, 2, "euclidean", same=True)):
        assert [got[i, p] for p in range(2)] == [j for j, _ in want]


def test_few_empty_and_missing(spark):
    a = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 2.0), ("c", float("nan"), 2.0)], "k string, f double, g double")
    b = spark.createDataFrame([("t", 1.0, 2.0, 5.0), ("u", None, 1.0, 6.0), ("v", 4.0, 6.0, None)], "k string, f double, g double, y double")
    got = [tuple(r) for r in neighbours.nearest(a, b, "k", ["f", "g"], "y", 5).orderBy("place").collect()]
    assert got == [("b", "t", 0, 0.0, 5.0), ("b", "v", 1, 5.0, None)]
    assert neighbours.nearest(a, b.limit(0), "k", ["f", "g"], "y").collect() == []
    assert neighbours.density(a, b.limit(0), "k", ["f", "g"]).collect() == [("b", None)]


def test_density_equals_all_pairs(spark, clouds, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    test, train = clouds
    a, names = table(spark, test, y=False)
    b, _ = table(spark, train)
    got = {r.id: r.density for r in neighbours.density(a, b, "id", names, 0.7).collect()}
    want = np.exp(-((test[:, None] - train[None]) ** 2).sum(2) / (2 * 0.7**2)).mean(1)
    assert np.allclose([got[i] for i in range(len(test))], want, atol=1e-12)


def test_300_000_training_rows(spark):
    """Neither table goes through the driver or to every task; few cells are searched where rows lie in clusters."""
    n = 300_000
    centre = lambda i: (F.pmod(F.xxhash64(F.col("id") % 500, F.lit(i)), F.lit(1000)) / 10).cast("double")
    noise = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 5000.0
    train = spark.range(n).select("id", *[(centre(i) + noise(i + 10)).alias(f"f{i}") for i in range(4)], F.lit(1.0).alias("y"))
    test = train.where("id % 30000 = 7").drop("y").withColumn("f0", F.col("f0") + 1e-4)
    names = [f"f{i}" for i in range(4)]
    near = neighbours.nearest(test, train, "id", names, "y", 3)
    got = near.collect()
    assert len(got) == 30 and all(r.neighbour == r.id for r in got if r.place == 0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "toPandas" not in inspect.getsource(neighbours)
    rows = neighbours.packed(train, "id", names, "y").select("id", "x", "y")
    cells, _ = neighbours.build(rows)
    x = np.array([r.x for r in neighbours.packed(test, "id", names).collect()])
    searched = (cells.open(x, cells.reach(x, 3)) * np.append(cells.count, cells.loose)).sum() / (n * len(x))
    assert searched < 0.1


def test_queries_are_copied_for_blocks_and_not_for_cells(spark):
    """Where no cell can be ruled out, a query is sent to each group of cells once, in frames of bounded size."""
    n = 3000
    data = spark.range(n).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0).alias(f"f{i}") for i in range(16)])
    rows = neighbours.packed(data, "id", [f"f{i}" for i in range(16)])
    cells, dealt = neighbours.build(rows)
    routed = neighbours._routed(rows.withColumn("bound", F.lit(None).cast("double")), cells, lambda part, x: (np.full(len(x), 9.0), True))
    assert (cells.count > 0).sum() > 40 and routed.count() == n
    a, b = neighbours._blocks(routed, dealt, cells)
    assert a.count() == n and b.count() == n


def test_density_counts_copies_once(spark):
    """60,000 rows in 50 places: as many points meet, with weights."""
    n = 60_000
    df = spark.range(n).select("id", (F.col("id") % 50).cast("double").alias("f"), (F.col("id") % 5 * 7).cast("double").alias("g"))
    points = neighbours._points(neighbours.packed(df, "id", ["f", "g"]))
    places = points.collect()
    assert len(places) == 50 and sum(r.weight for r in places) == n
    x = np.array([r.x for r in places])
    want = (np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2) * [r.weight for r in places]).sum(1) / n
    got = {(r.f, r.g): r.density for r in neighbours.density(df, df, "id", ["f", "g"]).join(df, "id").groupBy("f", "g").agg(F.max("density").alias("density")).collect()}
    assert np.allclose([got[tuple(p)] for p in x], want, rtol=1e-12)


def _copies(spark, monkeypatch, run):
    """How often the searches of `run` send a query on, where no cell can be ruled out."""
    sent, routed = [], neighbours._routed
    monkeypatch.setattr(neighbours, "_routed", lambda *a: (sent.append(routed(*a).count()), routed(*a))[1])
    data = spark.range(3000).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0).alias(f"f{i}") for i in range(16)], (F.col("id") % 7).cast("double").alias("y"))
    rows = run(data.where("id % 5 = 0"), data.where("id % 5 <> 0"), [f"f{i}" for i in range(16)]).count()
    return rows, sum(sent)


def test_neighbours_send_a_query_once_for_a_block(spark, monkeypatch):
    assert _copies(spark, monkeypatch, lambda test, train, names: neighbours.nearest(test, train, "id", names, "y", 5)) == (3000, 600)


def test_nearest_baseline_sends_a_query_once_for_a_block(spark, monkeypatch):
    assert _copies(spark, monkeypatch, lambda test, train, names: baselines.nearest(test, train, "id", names, "y")) == (600, 600)


@pytest.mark.parametrize("k", [4, 1])
def test_training_rows_of_a_block_are_compared_by_tiles(monkeypatch, k):
    """What a block needs besides its rows doesn't grow with them, and its nearest are those of all pairs."""
    r = np.random.default_rng(5)
    train, test = np.round(r.normal(0, 1, (3 * neighbours.TILE + 5, 6)), 1), np.round(r.normal(0, 1, (40, 6)), 1)
    train[::9], seen, run, distances = train[0], [], {}, neighbours.distances
    cells = neighbours.Cells(train[:8], "euclidean", 3.0)
    own, d = cells.own(train)
    cells.count, cells.radius = np.bincount(own, minlength=8), np.array([d[own == i].max(initial=0) for i in range(8)])
    side = SimpleNamespace(groupBy=lambda *a: SimpleNamespace(cogroup=lambda other: SimpleNamespace(applyInPandas=lambda work, schema: run.update(work=work))))
    monkeypatch.setattr(neighbours, "_blocks", lambda *a: (side, side))
    monkeypatch.setattr(neighbours, "distances", lambda a, b, *m: (seen.append(len(b)), distances(a, b, *m))[1])
    kind = SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))
    neighbours._search(SimpleNamespace(schema={"id": kind}), None, cells, k, False)
    left = pd.DataFrame({"id": np.arange(40), "x": list(test), "bound": np.nan, "reach": np.inf})
    got = run["work"](left, pd.DataFrame({"id": np.arange(len(train)), "x": list(train), "y": 1.0, "cell": own}))
    assert max(seen) <= neighbours.TILE
    for i, want in enumerate(brute(test, train, k, "euclidean")):
        assert got[got.id == i].neighbour.tolist() == [j for j, _ in want]


def test_rows_are_placed_a_chunk_at_a_time(monkeypatch):
    """What placing needs doesn't grow with the rows of a batch times the pivots."""
    x, seen, distances = np.random.default_rng(6).normal(0, 1, (3 * neighbours.CHUNK + 5, 4)), [], neighbours.distances
    cells = neighbours.Cells(x[::50], "euclidean", 3.0)
    want = distances(x, x[::50])
    monkeypatch.setattr(neighbours, "distances", lambda a, b, *m: (seen.append(len(a)), distances(a, b, *m))[1])
    cell, far = cells.own(x)
    assert max(seen) <= neighbours.CHUNK
    assert (cell == want.argmin(1)).all() and np.allclose(far, want.min(1))
