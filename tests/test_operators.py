"""Invariants and hand-checked cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import formula as fm
from lattica.functions import metrics as mt
from lattica.operators import cleaning, models, scaling, search, selection, splits, uncertainty
from lattica.plans import dataset, runs
from lattica.sources import files


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Al2O3", {"Al": 2, "O": 3}),
        ("Li3Fe2(PO4)3", {"Li": 3, "Fe": 2, "P": 3, "O": 12}),
        ("Y3N@C80", {"Y": 3, "N": 1, "C": 80}),
        ("[La0.75Sr0.25][Mn][O3]", {"La": 0.75, "Sr": 0.25, "Mn": 1, "O": 3}),
        ("Al(CoSi)2", {"Al": 1, "Co": 2, "Si": 2}),
    ],
)
def test_formula(text, parts):
    assert fm.parse(text) == pytest.approx(parts)


@pytest.mark.parametrize("text", ["NaCl)", "(Na", "2Na", "Xx", "Na-Cl"])
def test_formula_errors(text):
    with pytest.raises(ValueError):
        fm.parse(text)


def test_shells():
    assert fm.shells(26)[3, 2] == 6
    values = {(e, p): v for e, _, p, v in fm.element_rows()}
    assert values["O", "NpValence"] == 4 and values["O", "Row"] == 2 and values["Fe", "NdValence"] == 6 and values["Fe", "NValence"] == 8


def test_sites(spark):
    df = spark.createDataFrame([("[La0.75Sr0.25][Mn][O3]",)], "f string").select(fm.sites(F.col("f")).alias("s"))
    assert [(x.site, x.part) for x in df.first().s] == [(1, "La0.75Sr0.25"), (2, "Mn"), (3, "O3")]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 5.0)], "y_true double, y_pred double")
    got = mt.evaluate(df, ["mean_absolute_error", "mean_squared_error", "median_absolute_error", "r2_score", "rmse_over_stdev"]).first()
    assert tuple(got) == pytest.approx((0.25, 0.25, 0.0, 0.8, 0.447213595))
    with pytest.raises(NameError):
        mt.evaluate(df, ["none"])


def test_folds_partition_rows(spark):
    df = spark.range(103).withColumnRenamed("id", "row_id")
    for folds in (splits.exact_folds(df, "row_id", 5), splits.hash_folds(df, "row_id", 5)):
        sizes = {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()}
        assert sum(sizes.values()) == 103 and set(sizes) == set(range(5))
    sizes = [r["count"] for r in splits.exact_folds(df, "row_id", 5).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    roles = splits.train_test(splits.hash_folds(df, "row_id", 5), "row_id", 5)
    assert roles.where("role = 'test'").count() == 103 and roles.count() == 5 * 103


def test_bootstrap_draws(spark):
    df = spark.range(40).withColumnRenamed("id", "row_id")
    got = splits.bootstrap(df, "row_id", 4, 0.5).groupBy("split", "role").agg(F.sum("weight").alias("n")).collect()
    assert len(got) == 8 and {r.n for r in got} == {20}


def test_twins(spark):
    df = spark.createDataFrame([(i, float(i // 2), 1.0) for i in range(10)] + [(10, 99.0, 1.0)], "row_id long, a double, b double")
    assert splits.twins(df, "row_id", ["a", "b"]).count() == 10
    assert splits.twins(df, "row_id", ["a", "b"], 1.0).count() == 10
    assert {r.split for r in splits.leave_out_twins(df, "row_id", ["a", "b"]).collect()} == {0, 1}


def test_force_train(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    table = splits.force_train(splits.no_split(df, "row_id"), spark.createDataFrame([(99,)], "row_id long"), "row_id")
    assert table.where("row_id = 99 and role = 'train'").count() == 1


@pytest.mark.parametrize("name", ["StandardScaler", "MinMaxScaler", "MaxAbsScaler", "RobustScaler", "MeanStdevScaler"])
def test_scalers_invert(spark, name):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(10)], "row_id long, x double")
    scaler = scaling.Scaler(name).fit(df, ["x"])
    back = scaler.inverse(scaler.transform(df)).orderBy("row_id").collect()
    assert [r.x for r in back] == pytest.approx([float(i * i) for i in range(10)])


def test_scaler_of_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.x for r in scaling.Scaler("StandardScaler").fit_transform(df, ["x"]).collect()] == [0.0, 0.0]


def test_power_lambda(spark):
    df = spark.range(200).select((F.exp(F.col("id") / 50.0) - 1).alias("x"))
    assert scaling.power_lambda(df, "x") < 0.5


def test_outliers_of_a_spike(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(19)] + [(19, 100.0)], "row_id long, x double")
    assert [r.row_id for r in cleaning.outliers(df, "row_id", ["x"]).collect()] == [19]


def test_ppca_fills_a_plane(spark):
    r = np.random.default_rng(0)
    z = r.normal(size=(200, 2))
    x = z @ np.array([[1.0, 0.5, 2.0], [0.3, -1.0, 1.0]])
    rows = [(i, *(None if (i % 10 == j) else float(v) for j, v in enumerate(row))) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    got = cleaning.ppca(df, "row_id", ["a", "b", "c"], 2, rounds=60, tolerance=1e-9).toPandas().sort_values("row_id")
    assert np.abs(got[["a", "b", "c"]].to_numpy() - x).max() < 0.2


def test_linear_models_agree_with_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * r.normal(size=300)
    df = spark.createDataFrame([(i, *map(float, a), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y))], "row_id long, a double, b double, c double, y double, fold int")
    got = {r.fold: [r.b0, r.b_a, r.b_b, r.b_c] for r in models.linear_cv(df, ["a", "b", "c"], "y", "fold").collect()}
    for k in range(4):
        keep = np.arange(300) % 4 != k
        beta = np.linalg.lstsq(np.column_stack([np.ones(keep.sum()), x[keep]]), y[keep], rcond=None)[0]
        assert got[k] == pytest.approx(beta, abs=1e-9)
    assert [c for c, _ in selection.forward(df, ["a", "b", "c"], "y", "fold", 3)] == ["b", "a", "c"]
    assert selection.pearson(df, ["a", "b", "c"], "y")[0] == "b"


def test_calibration_recovers_a_scale(spark):
    r = np.random.default_rng(2)
    sigma = r.uniform(0.5, 2, 4000)
    df = spark.createDataFrame([(float(s), float(2 * s * e)) for s, e in zip(sigma, r.normal(size=4000))], "y_err double, residual double").cache()
    a, b = uncertainty.calibrate(df)
    assert a * 1.0 + b == pytest.approx(2.0, abs=0.15)


def test_search_space():
    space = search.parse_space("alpha ; kernel ; depth", "-1 1 3 log float ; rbf linear str ; 1 9 3 lin int")
    assert space["alpha"] == pytest.approx([0.1, 1, 10]) and space["kernel"] == ["rbf", "linear"] and space["depth"] == [1, 5, 9]
    assert search.count_combinations(space) == 18 == len(search.combinations(space))
    with pytest.raises(ValueError):
        search.parse_space("a;b", "1 int")


def test_bayesian_search_finds_a_minimum():
    tried = search.bayesian(lambda c: (c["x"] - 0.3) ** 2, {"x": (0.0, 1.0)}, 12)
    assert min(s for _, s in tried) < 0.01


def test_roles():
    assert dataset.infer_roles(["a", "b", "y"]) == (["a", "b"], "y")
    assert dataset.infer_roles(["a", "b", "y"], target="a") == (["b", "y"], "a")
    assert dataset.infer_roles(["a", "b", "y"], features=["a"]) == (["a"], "y")
    assert dataset.infer_roles(["a", "g", "y"], group="g") == (["a"], "y")


def test_load_turns_nan_into_null(spark):
    data = dataset.load(spark.createDataFrame([(1.0, math.nan), (2.0, 3.0)], "x double, y double"))
    assert data.df.where("y is null").count() == 1 and data.df.select("row_id").distinct().count() == 2


def test_unknown_file(spark):
    with pytest.raises(ValueError):
        files.read(spark, "table.pickle")
    with pytest.raises(KeyError):
        files.registered("nowhere")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "k int, v double")
    files.write(df, str(tmp_path / "t.csv"), "csv")
    assert sorted(map(tuple, files.read(spark, str(tmp_path / "t.csv"), "k int, v double").collect())) == [(1, 2.5), (2, 3.5)]


def test_friedman(spark):
    df = files.friedman(spark, 50)
    assert df.count() == 50 and len(df.columns) == 12


def test_run_record(tmp_path):
    folder = runs.run_folder(str(tmp_path), "run")
    runs.save_record(folder, model="linear", score=np.float64(0.5))
    assert runs.load_record(folder) == {"model": "linear", "score": 0.5}
    assert runs.run_folder(str(tmp_path), "run") != folder


def test_stream_scores(spark, tmp_path, sf_dir):
    from lattica.streaming.scoring import score_stream

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    li.limit(100).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(li.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, {"b0": 1.0, "l_quantity": 2.0}, str(tmp_path / "out"), str(tmp_path / "cp"), keep=["l_orderkey"])
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_elastic_net_meets_its_conditions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) + [1.0, 0.0, -2.0]
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    m = models._matrix(models.gram(df, ["a", "b", "c"], "y", []).first(), 5)
    for alpha, ratio in ((0.3, 1.0), (0.3, 0.5), (100.0, 1.0)):
        beta = models.solve_elastic(m, alpha, ratio)
        left = y - beta[0] - x @ beta[1:]
        slope = x.T @ left / len(y) - alpha * (1 - ratio) * beta[1:]
        assert abs(left.mean()) < 1e-9
        for b, g in zip(beta[1:], slope, strict=True):
            assert abs(g - alpha * ratio * np.sign(b)) < 1e-7 if b else abs(g) <= alpha * ratio + 1e-9
    assert np.allclose(models.solve_elastic(m, 0.0, 1.0), models.solve(m), atol=1e-6)


@pytest.mark.parametrize("name", ["StandardScaler", "RobustScaler", "NoPreprocessor"])
def test_scaler_is_saved(spark, tmp_path, name):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(20)], "id int, x double")
    scaler = scaling.Scaler(name).fit(df, ["x"])
    scaler.save(spark, str(tmp_path / "scaler"))
    again = scaling.Scaler.load(spark, str(tmp_path / "scaler"))
    assert sorted(again.transform(df).collect()) == sorted(scaler.transform(df).collect())


def test_linear_model_is_saved(spark, tmp_path):
    beta = {"b0": 1.5, "x": -2.0, "a": 0.25}
    models.save_linear(spark, beta, str(tmp_path / "model"))
    assert list(models.load_linear(spark, str(tmp_path / "model")).items()) == list(beta.items())


def test_features_below_a_dummy():
    ranking = [("a", 0.5), ("dummy_random_0", 0.2), ("b", 0.1), ("dummy_random_1", 0.05), ("c", 0.0)]
    with pytest.warns(UserWarning, match="b, c"):
        assert selection.below_dummies(ranking) == ["b", "c"]
    assert selection.below_dummies([("a", 1.0)]) == []


def test_bins_are_calibrated_by_themselves(spark):
    rng = np.random.default_rng(5)
    rows = [(b, float(s), float(rng.normal() * s * (b + 1))) for b in range(2) for s in rng.uniform(1, 3, 400)]
    df = spark.createDataFrame(rows, "bin int, y_err double, residual double").cache()
    got = {r.bin: (r.a, r.b) for r in uncertainty.calibrate_bins(df).collect()}
    for b in range(2):
        assert got[b] == pytest.approx(uncertainty.calibrate(df.where(F.col("bin") == b)), abs=1e-6)
    df.unpersist()


@pytest.mark.parametrize(("method", "rows", "columns"), [("drop_rows", 2, 3), ("drop_columns", 4, 2), ("impute", 4, 3)])
def test_clean(spark, method, rows, columns):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, float("nan"), "7"), (4, 2.0, "c")], "id int, x double, s string")
    out = cleaning.clean(df, "id", method, ["x"])
    assert out.data.count() == rows and len(out.data.columns) == columns and out.strings == ["s"]
    with pytest.raises(ValueError, match="no method"):
        cleaning.clean(df, "id", "scrub", ["x"])
