"""The planner: split, scale, fit, score, and recalibrate, as one chain of frames.

There are no folders per split: predictions are one long table with the split as a column, and every
later table is a query on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.metrics import evaluate as metrics_of
from lattica.functions.metrics import over_splits
from lattica.functions.order import hash_number
from lattica.operators import models, splits, uncertainty

from .dataset import Dataset


@dataclass
class Result:
    """predictions: (split, row_id, y_true, y_pred, residual); per_split and overall: metrics."""

    predictions: DataFrame
    per_split: DataFrame
    overall: DataFrame
    calibration: list[float] | None = None


def evaluate(data: Dataset, k: int = 5, metrics: tuple[str, ...] = ("root_mean_squared_error", "r2_score"), alpha: float = 0.0, standardize: bool = True, exact: bool = False, group: bool = False) -> Result:
    """Cross-validate a linear model.

    Standardizing needs no pass of its own for a plain linear model, whose predictions don't depend on
    it; with a ridge penalty the features are scaled by statistics of all rows.
    """
    df = data.projected()
    if group:
        folds = splits.leave_one_group_out(df, data.row_id, data.group)
        df = df.join(folds, data.row_id)
    elif exact:
        df = df.join(splits.exact_folds(df, data.row_id, k), data.row_id)
    else:
        df = df.withColumn("fold", (hash_number(data.row_id) % k).cast("int"))
    if alpha and standardize:
        from lattica.operators.scaling import Scaler

        df = Scaler("StandardScaler").fit_transform(df, data.features)
    fitted = models.linear_cv(df, data.features, data.target, "fold", alpha)
    predicted = models.predict_linear(df, fitted, data.features, "fold")
    out = predicted.select(F.col("fold").alias("split"), F.col(data.row_id).alias("row_id"), *([data.group] if data.group else []), F.col(data.target).cast("double").alias("y_true"), "y_pred")
    out = out.withColumn("residual", F.col("y_pred") - F.col("y_true"))
    per = metrics_of(out, list(metrics), ["split"])
    return Result(out, per, over_splits(per, list(metrics)))


def nested(data: Dataset, outer: int = 3, inner: int = 3, metrics: tuple[str, ...] = ("root_mean_squared_error",)) -> DataFrame:
    """Rows (outer, part, <metrics>): inner scores by cross-validation, and outer rows scored by the best inner split's model.

    Each row is expanded once per outer split; the best inner split is that of the least RMSE, ties to
    the lesser number.
    """
    df = data.projected().join(splits.nested(data.df, data.row_id, outer, inner), data.row_id)
    key = (F.col("outer") * inner + F.col("inner")).alias("fold")
    train = df.where("inner is not null").select("*", key)
    width = len(data.features) + 2
    rows = models.gram(train, data.features, data.target, ["outer", "inner"]).collect()
    table = []
    for o in range(outer):
        parts = {r.inner: models._matrix(r, width) for r in rows if r.outer == o}
        total = sum(parts.values())
        table += [(o, i, *map(float, models.solve(total - m))) for i, m in parts.items()]
    names = ", ".join(["b0 double", *[f"`b_{c}` double" for c in data.features]])
    fitted = data.df.sparkSession.createDataFrame(table, f"outer int, inner int, {names}")
    scored = models.predict_linear(train.drop("fold"), fitted, data.features, ["outer", "inner"]).withColumn("y_true", F.col(data.target).cast("double"))
    per = metrics_of(scored, list(dict.fromkeys([*metrics, "root_mean_squared_error"])), ["outer", "inner"])
    best = per.groupBy("outer").agg(F.min_by("inner", F.struct("root_mean_squared_error", "inner")).alias("inner"))
    left = df.where("inner is null").drop("inner").join(F.broadcast(best), "outer")  # a row per outer split
    tested = models.predict_linear(left, fitted, data.features, ["outer", "inner"]).withColumn("y_true", F.col(data.target).cast("double"))
    inside = metrics_of(scored, list(metrics), ["outer"]).withColumn("part", F.lit("inner"))
    return inside.unionByName(metrics_of(tested, list(metrics), ["outer"]).withColumn("part", F.lit("outer"))).select("outer", "part", *metrics)


def left_out(data: Dataset, left: DataFrame, metrics: tuple[str, ...] = ("root_mean_squared_error",)) -> DataFrame:
    """Fit on the rows outside `left` (row_id, leave_out_set) and score each left-out set."""
    df = data.projected()
    ids = left.select(F.col(data.row_id)).distinct()
    beta = models.linear_fit(df.join(ids, data.row_id, "left_anti"), data.features, data.target)
    tested = df.join(left, data.row_id).withColumn("y_pred", models.linear_expression(beta)).withColumn("y_true", F.col(data.target).cast("double"))
    return metrics_of(tested, list(metrics), ["leave_out_set"])


def with_uncertainty(data: Dataset, k: int = 5, bags: int = 20, power: int = 1) -> Result:
    """Cross-validate bagged linear models and recalibrate their deviations on the test residuals.

    The bags of all folds come from one aggregation over (fold, bag).
    """
    df = data.projected().withColumn("fold", (hash_number(data.row_id) % k).cast("int"))
    expanded = df.select(data.row_id, *data.features, data.target, "fold", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag"))
    rows = models.gram(expanded, data.features, data.target, ["fold", "bag"], models.bag_weight(data.row_id, F.col("bag"))).collect()
    width = len(data.features) + 2
    parts = {(r.fold, r.bag): models._matrix(r, width) for r in rows}
    table = []
    for fold in range(k):
        for bag in range(bags):
            m = sum((x for (f, b), x in parts.items() if b == bag and f != fold), start=0)
            if not isinstance(m, int):
                table.append((fold, [*map(float, models.solve(m))], bag))
    fitted = df.sparkSession.createDataFrame(table, "fold int, b array<double>, bag int").groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("bag", "b"))).alias("__m"))

    def one(m):
        y = F.get(m["b"], 0)
        for i, c in enumerate(data.features):
            y = y + F.get(m["b"], i + 1) * F.col(c)
        return y

    wide = df.join(F.broadcast(fitted), "fold").withColumn("learners", F.transform("__m", one)).drop("__m")  # a row per fold
    scored = models.with_deviation(wide).select(F.col("fold").alias("split"), F.col(data.row_id).alias("row_id"), F.col(data.target).cast("double").alias("y_true"), "y_pred", "y_err")
    scored = scored.withColumn("residual", F.col("y_pred") - F.col("y_true")).persist()
    parameters = uncertainty.calibrate(scored, power)
    out = scored.withColumn("y_err_cal", uncertainty.recalibrated(F.col("y_err"), [F.lit(a) for a in parameters]))
    per = metrics_of(out, ["root_mean_squared_error"], ["split"])
    return Result(out, per, over_splits(per, ["root_mean_squared_error"]), parameters)
