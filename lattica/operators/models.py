"""Models: linear ones from sufficient statistics, neighbours, bags, and pyspark.ml by name."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.order import hash_number
from lattica.functions.workers import ship

ship(__name__)

# ---------------------------------------------------------------- linear models
def gram(df: DataFrame, features: list[str], target: str, by: list[str], weight: Column | None = None) -> DataFrame:
    """Sums of products of (1, features, target) by group: all that a linear model needs, in one pass."""
    names = ["1", *features, target]
    value = {c: F.lit(1.0) if c == "1" else F.col(c).cast("double") for c in names}
    w = F.lit(1.0) if weight is None else weight.cast("double")
    sums = [F.sum(w * value[a] * value[b]).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    complete = df.where(" and ".join(f"`{c}` is not null" for c in [*features, target]))
    return complete.groupBy(*by).agg(*sums)


def _matrix(row, width: int) -> np.ndarray:
    m = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            m[i, j] = m[j, i] = row[f"s_{i}_{j}"] or 0.0
    return m


def solve(m: np.ndarray, alpha: float = 0.0) -> np.ndarray:
    """Intercept and coefficients from a matrix of sums; alpha penalises the coefficients' squares.

    The features are centred first, which spares digits.
    """
    n, k = m[0, 0], len(m) - 2
    if n <= 0:
        return np.zeros(k + 1)
    mean = m[0, 1:] / n
    c = m[1:, 1:] - n * np.outer(mean, mean)
    beta = np.linalg.lstsq(c[:k, :k] + alpha * np.eye(k), c[:k, k], rcond=None)[0] if k else np.zeros(0)
    return np.concatenate([[mean[k] - mean[:k] @ beta], beta])


def solve_elastic(m: np.ndarray, alpha: float, ratio: float, rounds: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """Intercept and coefficients of least absolute shrinkage (ratio 1) or an elastic net, from a matrix of sums.

    Minimises half the mean squared error, plus alpha * ratio times the coefficients' absolute values
    and alpha * (1 - ratio) / 2 times their squares, by coordinate descent.
    """
    n, k = m[0, 0], len(m) - 2
    if n <= 0:
        return np.zeros(k + 1)
    mean = m[0, 1:] / n
    c = m[1:, 1:] / n - np.outer(mean, mean)
    beta = np.zeros(k)
    for _ in range(rounds):
        before = beta.copy()
        for j in range(k):
            left = c[j, k] - c[j, :k] @ beta + c[j, j] * beta[j]
            beta[j] = np.sign(left) * max(abs(left) - alpha * ratio, 0.0) / ((c[j, j] + alpha * (1 - ratio)) or 1.0)
        if np.abs(beta - before).max(initial=0.0) <= tolerance * max(1.0, np.abs(beta).max(initial=0.0)):
            break
    return np.concatenate([[mean[k] - mean[:k] @ beta], beta])


def linear_cv(df: DataFrame, features: list[str], target: str, fold: str, alpha: float = 0.0, l1_ratio: float | None = None) -> DataFrame:
    """Rows (fold, b0, b_<feature>...): the model that is trained on all other folds.

    Sums per fold are taken once and train = total - fold, so rows aren't repeated k times. What
    comes to the driver are folds * features**2 numbers. With l1_ratio, alpha is that of an elastic net,
    otherwise of a ridge.
    """
    rows = gram(df, features, target, [fold]).collect()
    width = len(features) + 2
    parts = {r[fold]: _matrix(r, width) for r in rows}
    total = sum(parts.values(), np.zeros((width, width)))
    kind = dict(df.dtypes)[fold]
    schema = f"`{fold}` {kind}, b0 double, " + ", ".join(f"`b_{c}` double" for c in features)
    fitted = lambda m: solve(m, alpha) if l1_ratio is None else solve_elastic(m, alpha, l1_ratio)
    return df.sparkSession.createDataFrame([(k, *map(float, fitted(total - m))) for k, m in parts.items()], schema)


def linear_fit(df: DataFrame, features: list[str], target: str, alpha: float = 0.0) -> dict[str, float]:
    row = gram(df, features, target, []).first()
    beta = solve(_matrix(row, len(features) + 2), alpha)
    return dict(zip(["b0", *features], map(float, beta), strict=True))


def save_linear(spark: SparkSession, beta: dict[str, float], path: str) -> None:
    """Write the coefficients with their names."""
    spark.createDataFrame([(i, c, float(b)) for i, (c, b) in enumerate(beta.items())], "place int, name string, value double").coalesce(1).write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str) -> dict[str, float]:
    return {r.name: r.value for r in spark.read.parquet(path).orderBy("place").collect()}


def linear_expression(beta: dict[str, float]) -> Column:
    out = F.lit(beta["b0"])
    for c, b in beta.items():
        out = out + F.lit(b) * F.col(c) if c != "b0" else out
    return out


def predict_linear(df: DataFrame, models: DataFrame, features: list[str], by: str, name: str = "y_pred") -> DataFrame:
    """df with the prediction of its group's model; the models are one row per group."""
    wide = df.join(F.broadcast(models), by)
    y = F.col("b0")
    for c in features:
        y = y + F.col(f"b_{c}") * F.col(c)
    return wide.withColumn(name, y).drop("b0", *[f"b_{c}" for c in features])


def bag_uniform(row_id: str, bag: Column) -> Column:
    """A number from 0 to 1 by the hash of a row and a bag."""
    return hash_number(row_id, bag, seed="bag") / F.lit(4294967296.0)


def poisson(u: Column) -> Column:
    """The Poisson(1) number at a share u of the distribution, as bootstraps of large tables tend to draw a row."""
    cumulative, term, out = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(1, 9):
        cumulative += term
        out = out + F.when(u >= cumulative, 1).otherwise(0)
        term /= k
    return out


def bag_weight(row_id: str, bag: Column) -> Column:
    """How often a bag draws a row."""
    return poisson(bag_uniform(row_id, bag))


def bagged_linear(df: DataFrame, row_id: str, features: list[str], target: str, bags: int) -> DataFrame:
    """Rows (bag, b0, b_...): a linear model for each bag, from one aggregation."""
    expanded = df.select(row_id, *features, target, F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag"))
    rows = gram(expanded, features, target, ["bag"], bag_weight(row_id, F.col("bag"))).collect()
    schema = "bag int, b0 double, " + ", ".join(f"`b_{c}` double" for c in features)
    return df.sparkSession.createDataFrame([(r.bag, *map(float, solve(_matrix(r, len(features) + 2)))) for r in rows], schema)


def predict_bags(df: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """df with y_pred (the bags' mean), learners (each bag's prediction) and y_err (their deviation)."""
    table = models.agg(F.array_sort(F.collect_list(F.struct("bag", F.array("b0", *[f"b_{c}" for c in features]).alias("b")))).alias("__m"))

    def one(m: Column) -> Column:
        out = F.get(m["b"], 0)
        for i, c in enumerate(features):
            out = out + F.get(m["b"], i + 1) * F.col(c)
        return out

    wide = df.join(F.broadcast(table)).withColumn("learners", F.transform("__m", one)).drop("__m")  # one row
    return with_deviation(wide)


def with_deviation(df: DataFrame, learners: str = "learners") -> DataFrame:
    """df with y_pred and y_err, the mean and population deviation of an array of predictions."""
    mean = F.aggregate(learners, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size(learners))
    out = df.withColumn("y_pred", mean)
    return out.withColumn("y_err", F.sqrt(F.aggregate(learners, F.lit(0.0), lambda s, x: s + F.pow(x - F.col("y_pred"), 2), lambda s: s / F.size(learners))))


# ---------------------------------------------------------------- pyspark.ml by name
def estimator(name: str, **options):
    """A pyspark.ml estimator by name; features come as a vector in `features`."""
    from pyspark.ml import classification, regression

    places = {
        "LinearRegression": (regression.LinearRegression, {"solver": "normal", "standardization": False}),
        "RandomForestRegressor": (regression.RandomForestRegressor, {}),
        "DecisionTreeRegressor": (regression.DecisionTreeRegressor, {}),
        "GradientBoostingRegressor": (regression.GBTRegressor, {}),
        "FMRegressor": (regression.FMRegressor, {}),
        "LogisticRegression": (classification.LogisticRegression, {}),
        "RandomForestClassifier": (classification.RandomForestClassifier, {}),
        "DecisionTreeClassifier": (classification.DecisionTreeClassifier, {}),
        "NaiveBayes": (classification.NaiveBayes, {}),
    }
    if name not in places:
        raise ValueError(f"no model {name!r}; there are {', '.join(places)}")
    kind, defaults = places[name]
    return kind(**(defaults | options))


def fit(df: DataFrame, features: list[str], target: str, name: str, **options):
    """A fitted pipeline: assembler and model. Persist it with its own writer."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    model = estimator(name, labelCol=target, featuresCol="__features", predictionCol="y_pred", **options)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="skip"), model]).fit(df)


# ---------------------------------------------------------------- neighbours (exact ones are in operators.neighbours)
def approximate_neighbours(test: DataFrame, train: DataFrame, row_id: str, features: list[str], radius: float):
    """Pairs within a radius by random projections, for training tables of any size."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, VectorAssembler

    ready = VectorAssembler(inputCols=features, outputCol="__f")
    model = BucketedRandomProjectionLSH(inputCol="__f", outputCol="__h", bucketLength=radius, numHashTables=6, seed=1).fit(ready.transform(train))
    pairs = model.approxSimilarityJoin(ready.transform(test), ready.transform(train), radius, "distance")
    return pairs.select(F.col(f"datasetA.{row_id}").alias(row_id), F.col(f"datasetB.{row_id}").alias("neighbour"), "distance")


def knn_regress(near: DataFrame, row_id: str) -> DataFrame:
    return near.groupBy(row_id).agg(F.avg("y").alias("y_pred"))


def knn_classify(near: DataFrame, row_id: str) -> DataFrame:
    """The most frequent label among the neighbours, the least of several."""
    return near.groupBy(row_id).agg(F.mode("y", True).alias("y_pred"))
