"""Clusters by density and single links, and spanning trees, against brute force."""

import numpy as np
import pytest

from lattica.functions.graph import components
from lattica.operators import clustering, neighbours


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(c, 0.3, (110, 2)) for c in (0, 2, 5)] + [np.round(r.uniform(-2, 8, (150, 2))), np.tile([[5.0, 5.0]], (20, 1))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 1.0)], "id long, a double, b double").repartition(4)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 12)
    return df, x, d


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("eps", "least", "block"), [(0.3, 5, 4096), (1.0, 4, 40), (0.05, 1, 4096)])
def test_dbscan(cloud, monkeypatch, eps, least, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERIES", block)
    df, x, d = cloud
    near = d <= eps
    core = near.sum(1) >= least
    found = roots(len(x), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if core[i] and core[j] and i < j])
    want = {}
    for i in range(len(x)):
        if core[i]:
            want[i] = (found[i], True)
        else:
            hosts = [(d[i, j], j) for j in np.flatnonzero(near[i] & core)]
            want[i] = (found[min(hosts)[1]] if hosts else None, False)
    assert {r.id: (r.cluster, r.core) for r in clustering.dbscan(df, "id", ["a", "b"], eps, least).collect()} == want


def test_spanning_tree_and_single_links(cloud):
    df, x, d = cloud
    n = len(x)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    length, tree = 0.0, []
    for w, i, j in sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            length += w
            tree.append((w, i, j))
    edges = clustering.spanning_forest(df, "id", ["a", "b"]).collect()
    assert len(edges) == n - 1 and sum(e.distance for e in edges) == pytest.approx(length)
    assert len(set(roots(n, [(e.u, e.v) for e in edges]))) == 1
    # cuts at a distance that isn't tied
    lengths = sorted((w for w, _, _ in tree), reverse=True)
    k = next(k for k in range(3, 40) if lengths[k - 2] > lengths[k - 1])
    want = roots(n, [(i, j) for w, i, j in tree if w < lengths[k - 2]])
    assert len(set(want)) == k
    got = {r.id: r.cluster for r in clustering.single_link(df, "id", ["a", "b"], n_clusters=k).collect()}
    assert [got[i] for i in range(n)] == want
    got = {r.id: r.cluster for r in clustering.single_link(df, "id", ["a", "b"], distance=0.4).collect()}
    assert [got[i] for i in range(n)] == roots(n, [(i, j) for i in range(n) for j in range(i) if d[i, j] <= 0.4])


def test_few_points(spark):
    one = spark.createDataFrame([("a", 1.0)], "id string, f double")
    assert [tuple(r) for r in clustering.dbscan(one, "id", ["f"], 1.0, 1).collect()] == [("a", "a", True)]
    assert [tuple(r) for r in clustering.dbscan(one, "id", ["f"], 1.0, 2).collect()] == [("a", None, False)]
    assert [tuple(r) for r in clustering.single_link(one, "id", ["f"], n_clusters=2).collect()] == [("a", "a")]
    assert clustering.dbscan(one.limit(0), "id", ["f"], 1.0).collect() == []
    assert clustering.single_link(one.limit(0), "id", ["f"], distance=1.0).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 13] + [(100, 5), (7, 7), (None, None)], "u long, v long").where("u is not null")
    got = {r.node: r.root for r in components(edges).collect()}
    want = roots(101, [(i, i + 1) for i in range(40) if i % 13] + [(100, 5)])
    assert all(got[i] == want[i] for i in got) and set(got) == {i for e in edges.collect() for i in e if tuple(e) != (7, 7)}
