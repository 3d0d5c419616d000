"""The experiment planner, successive halving, oxidation states and the automatic twin threshold."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import formula as fm
from lattica.functions import oxidation
from lattica.operators import splits
from lattica.plans import dataset, experiment


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (300, 4))
    y = 3 * x[:, 1] - x[:, 3] + r.normal(0, 0.2, 300)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0, 1.0, 1.0, 1.0), (901, 1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double")
    return dataset.load(df, "id", features=["a", "b", "c", "d"], target="y"), x, y


def test_members_equal_separate_fits(data):
    d, x, y = data
    members = {"plain": experiment.Linear(), "ridge": experiment.Linear(50.0), "lasso": experiment.Linear(0.1, 1.0)}
    chosen = {"all": experiment.all_features, "two": experiment.best_correlated(2), "steps": experiment.forward(2), "none": experiment.varying(1e9)}
    e = experiment.Experiment(d, members, chosen, ("root_mean_squared_error", "r2_score", "mean_absolute_error"), 3)
    got = {(r.model, r.selector, r.split, r.metric): r.value for r in e.run().collect()}
    assert len(got) == 3 * 4 * 3 * 3
    folds = {r.id: r.fold for r in e.folded().collect()}
    fold = np.array([folds[i] for i in range(300)])
    for k, (name, own) in itertools.product(range(3), (("all", [0, 1, 2, 3]), ("two", [1, 3]), ("steps", [1, 3]), ("none", []))):
        train, test = fold != k, fold == k
        a = np.column_stack([np.ones(train.sum()), x[train][:, own]])
        b = np.linalg.lstsq(a, y[train], rcond=None)[0]
        p = np.column_stack([np.ones(test.sum()), x[test][:, own]]) @ b
        assert got["plain", name, k, "root_mean_squared_error"] == pytest.approx(np.sqrt(((p - y[test]) ** 2).mean()))
        assert got["plain", name, k, "mean_absolute_error"] == pytest.approx(np.abs(p - y[test]).mean())
        assert got["plain", name, k, "r2_score"] == pytest.approx(1 - ((p - y[test]) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
    best = {r.model: r.selector for r in experiment.best_members(e.run(), "root_mean_squared_error").collect()}
    assert set(best) == set(members) and best["plain"] != "none"


def test_one_scan_serves_all_linear_members(spark, data, tmp_path):
    d, _, _ = data
    path = str(tmp_path / "rows")
    d.df.write.parquet(path)
    stored = dataset.load(spark.read.parquet(path), "id", features=d.features, target="y")
    members = {f"ridge{a}": experiment.Linear(float(a)) for a in range(30)}
    before = spark.sparkContext.statusTracker()
    jobs = lambda: len(before.getJobIdsForGroup("scan"))
    spark.sparkContext.setJobGroup("scan", "sums")
    e = experiment.Experiment(stored, members, {"all": experiment.all_features, "two": experiment.best_correlated(2)}, k=5)
    e.sums()
    of_sums = jobs()
    out = e.run()
    assert out.count() == 30 * 2 * 5 * 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Scan parquet" not in out._jdf.queryExecution().executedPlan().toString()  # scores are already there
    assert jobs() <= 2 * of_sums + 2


def test_other_members_share_the_folds(data):
    d, x, y = data
    members = {"forest": experiment.forest(trees=4, depth=3), "near": experiment.nearest(3), "gp": experiment.gaussian_process(kernel="RBF+WhiteKernel", most=60)}
    got = {(r.model, r.split): r.value for r in experiment.Experiment(d, members, metrics=("r2_score",), k=2).run().collect()}
    assert len(got) == 6 and min(got.values()) > 0.5


def test_halving(spark):
    df = spark.range(9000).select("id")
    seen = []

    def score(own, c):
        seen.append((c["x"], own.count()))
        return abs(c["x"] - 6.3)

    found = experiment.halving(df, "id", [{"x": i} for i in range(20)], score, eta=3, least=100)
    assert found[-1][0] == {"x": 6} and found[-1][1] == 2
    rounds = {r: sum(1 for _, q, _ in found if q == r) for r in range(3)}
    assert rounds == {0: 20, 1: 6, 2: 2}
    sizes = [max(n for x, n in seen[a:b]) for a, b in ((0, 20), (20, 26), (26, 28))]
    assert 800 < sizes[0] < 1200 and 2700 < sizes[1] < 3300 and sizes[2] == 9000


def test_oxidation_states(spark):
    formulas = ["".join(p) for p in itertools.product(("Na", "Fe2", "Mn3", "Ti"), ("", "S", "Cr2"), ("O", "O3", "O4", "Cl2"))] + ["Xe", "XeO", "Cu", "La0.5Sr0.5MnO3"]
    parts = fm.elements(spark.createDataFrame([(f,) for f in formulas], "formula string"), "formula")
    got = {r.formula: r.charges for r in oxidation.guess(parts, "formula").collect()}
    for f in formulas:
        amounts = fm.parse(f)
        names = sorted(amounts)
        if len(names) == 1:
            want = {names[0]: 0}
        else:
            ways = [s for s in itertools.product(*[oxidation.STATES.get(e, ()) for e in names]) if abs(sum(q * amounts[e] for q, e in zip(s, names, strict=True))) <= 1e-6]
            best = min(ways, key=lambda s: (max(s) - min(s), s), default=None)
            want = dict(zip(names, best, strict=True)) if best else None
        assert got[f] == want, f
    guessed = oxidation.guess(parts, "formula")
    row = oxidation.states_of(guessed, "Fe").first()
    assert row.n_total == len(formulas) and row.n_guesses == sum(v is not None for v in got.values()) and row.n_atoms == sum("Fe" in (v or {}) for v in got.values())
    assert {r.formula for r in oxidation.ionic(guessed).where("ionic").collect()} == {f for f, v in got.items() if v and any(v.values())}
    assert oxidation.with_state(guessed, "Na").where("formula = 'NaCl2'").first().state is None


@pytest.mark.parametrize(("threshold", "order", "ceiling"), [(0.0, 2.0, 0.3), (0.05, 1.0, 0.0), (0.0, float("inf"), 0.9)])
def test_twin_threshold_is_that_of_the_loop(spark, threshold, order, ceiling):
    x = np.random.default_rng(0).uniform(0, 30, (40, 2)).round(2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    gap = np.abs(x[:, None] - x[None])
    d = gap.max(2) if np.isinf(order) else (gap**order).sum(2) ** (1 / order)
    np.fill_diagonal(d, np.inf)
    want, t, steps = max(int(ceiling * 40), 2), threshold, []
    while True:
        twins = {int(i) for i in np.flatnonzero((d <= t).any(1))}
        steps.append((t, len(twins)))
        if len(twins) >= want:
            break
        t = (t if t > 0 else 0.1) * 1.1
    got, found, table = splits.auto_twins(df, "id", ["a", "b"], threshold, order, ceiling)
    assert got == pytest.approx(t) and {r.id for r in found.collect()} == twins
    rows = table.orderBy("threshold").collect()
    assert [r.threshold for r in rows] == pytest.approx([t for t, _ in steps]) and [r.n_twins for r in rows] == [n for _, n in steps]
