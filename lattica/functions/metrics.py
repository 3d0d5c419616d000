"""Regression and classification metrics as aggregate expressions.

All metrics of a call share one aggregation. t is the true value, p the prediction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.order import running


def _mse(t: Column, p: Column) -> Column:
    return F.avg(F.pow(t - p, 2))


def _r2(t: Column, p: Column) -> Column:
    return 1 - F.sum(F.pow(t - p, 2)) / F.nullif(F.var_pop(t) * F.count(t), F.lit(0.0))


def _r2_through_origin(t: Column, p: Column) -> Column:
    """R2 of the fit p = b t."""
    tp, tt, pp = F.sum(t * p), F.sum(t * t), F.sum(p * p)
    return 1 - (pp - tp * tp / tt) / F.nullif(F.var_pop(p) * F.count(p), F.lit(0.0))


#: Name: (greater is better, expression).
REGRESSION: dict[str, tuple[bool, Callable[[Column, Column], Column]]] = {
    "explained_variance": (True, lambda t, p: 1 - F.var_pop(t - p) / F.nullif(F.var_pop(t), F.lit(0.0))),
    "mean_absolute_error": (False, lambda t, p: F.avg(F.abs(t - p))),
    "mean_squared_error": (False, _mse),
    "mean_squared_log_error": (False, lambda t, p: F.when(F.min(F.least(t, p)) >= 0, F.avg(F.pow(F.log1p(F.greatest(t, F.lit(0.0))) - F.log1p(F.greatest(p, F.lit(0.0))), 2)))),
    "median_absolute_error": (False, lambda t, p: F.median(F.abs(t - p))),
    "r2_score": (True, _r2),
    "r2_score_noint": (True, _r2_through_origin),
    "r2_score_fitted": (True, lambda t, p: F.regr_r2(p, t)),
    "root_mean_squared_error": (False, lambda t, p: F.sqrt(_mse(t, p))),
    "rmse_over_stdev": (False, lambda t, p: F.sqrt(_mse(t, p)) / F.nullif(F.stddev_pop(t), F.lit(0.0))),
}


def complete(t: Column, p: Column) -> tuple[Column, Column]:
    """Both values where there are both, else null: sums of one then run over the same rows as sums of both."""
    return F.when(p.isNotNull(), t), F.when(t.isNotNull(), p)


def adjusted_r2(t: Column, p: Column, n_features: int | None) -> Column:
    """R2 adjusted for the number of features; null where that isn't known or too few rows are left."""
    if n_features is None:
        return F.lit(None).cast("double")
    n = F.count(t)
    return 1 - (1 - _r2(t, p)) * (n - 1) / F.nullif(n - n_features - 1, F.lit(0))


def evaluate(df: DataFrame, names: list[str], by: list[str] | None = None, t: str = "y_true", p: str = "y_pred", n_features: int | None = None) -> DataFrame:
    """One row per group with a column for each metric, from one aggregation.

    Rows without a true value or without a prediction don't count, in any part of a metric.
    """
    columns = []
    true, predicted = complete(F.col(t), F.col(p))
    for name in names:
        if name == "r2_score_adjusted":
            columns.append(adjusted_r2(true, predicted, n_features).alias(name))
        elif name in REGRESSION:
            columns.append(REGRESSION[name][1](true, predicted).alias(name))
        else:
            raise NameError(f"no metric {name!r}; there are {', '.join([*REGRESSION, 'r2_score_adjusted'])}")
    return df.groupBy(*(by or [])).agg(*columns)


def over_splits(per_split: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows (metric, mean, stdev): mean and population deviation of each metric over the splits."""
    long = per_split.unpivot(by or [], names, "metric", "value") if by else per_split.select(*names).unpivot([], names, "metric", "value")
    return long.groupBy(*(by or []), "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("stdev"))


def confusion(df: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    return df.groupBy(F.col(t).alias("label"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def report(df: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Rows (label, precision, recall, f1, support), from the confusion matrix."""
    cells = confusion(df, t, p)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    true = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    guess = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    both = true.join(guess, "label", "full_outer").na.fill(0, ["support", "tp", "guessed"])
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision, recall = safe(F.col("tp"), F.col("guessed")), safe(F.col("tp"), F.col("support"))
    return both.select("label", precision.alias("precision"), recall.alias("recall"), safe(2 * precision * recall, precision + recall).alias("f1"), F.col("support").cast("bigint").alias("support"))


def averages(reported: DataFrame) -> DataFrame:
    """Rows (average, precision, recall, f1): macro and weighted."""
    weight = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    names = ["precision", "recall", "f1"]
    macro = reported.agg(*[F.avg(c).alias(c) for c in names]).select(F.lit("macro").alias("average"), *names)
    return macro.unionByName(reported.agg(*[weight(c) for c in names]).select(F.lit("weighted").alias("average"), *names))


def accuracy(df: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    return df.agg(F.avg((F.col(t) == F.col(p)).cast("double")).alias("accuracy"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from counts of distinct scores (ties count half).

    Scores are grouped first; the running sums go over distinct scores.
    """
    grouped = df.groupBy(score).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    walked = running(grouped, [score], {"__below": F.col("neg")}).withColumn("won", F.col("pos") * (F.col("__below") + F.col("neg") / 2))
    return walked.agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("roc_auc"))


def log_loss(df: DataFrame, label: str, probability: str, eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.least(F.col(probability), F.lit(1 - eps)), F.lit(eps))
    return df.agg(F.avg(-F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def robust_l1(t: Column, p: Column, s: Column) -> Column:
    """Robust absolute loss with a log deviation s."""
    return F.avg(F.sqrt(F.lit(2.0)) * F.abs(t - p) * F.exp(-s) + s)


def robust_l2(t: Column, p: Column, s: Column) -> Column:
    return F.avg(0.5 * F.pow(t - p, 2) * F.exp(-2 * s) + s)
