"""Naive predictions that a model has to beat, as tables (row_id, y_fake)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.order import md5_of, ranked

from . import neighbours


def mean_of(df: DataFrame, row_id: str, y: str, train: DataFrame | None = None) -> DataFrame:
    """The mean of the tested values, or of a training table's."""
    mean = (df if train is None else train).agg(F.avg(y).alias("y_fake"))
    return df.select(row_id).join(F.broadcast(mean))  # one row


def permuted(df: DataFrame, row_id: str, y: str, name: str = "y_fake", seed: int = 0) -> DataFrame:
    """Every row gets the value of another: ranks by one hash meet ranks by a second."""
    own = ranked(df.select(row_id, md5_of(row_id, seed=f"own{seed}").alias("__key")), "__key", "__rank").select(row_id, "__rank")
    other = ranked(df.select(F.col(y).alias(name), md5_of(row_id, seed=f"other{seed}").alias("__key")), "__key", "__rank").select(name, "__rank")
    return own.join(other, "__rank").select(row_id, name)


def nearest(test: DataFrame, train: DataFrame, row_id: str, features: list[str], y: str, metric: str = "euclidean") -> DataFrame:
    return neighbours.nearest(test, train, row_id, features, y, 1, metric).select(row_id, F.col("y").alias("y_fake"))


def random_class(df: DataFrame, row_id: str, y: str, seed: int = 0) -> DataFrame:
    """One class for all rows, chosen by a seed among the classes there are."""
    pick = df.select(y).where(F.col(y).isNotNull()).distinct().orderBy(md5_of(y, seed=seed)).limit(1).withColumnRenamed(y, "y_fake")
    return df.select(row_id).join(F.broadcast(pick))  # one row


def dominant_class(df: DataFrame, row_id: str, y: str) -> DataFrame:
    top = df.agg(F.mode(y, True).alias("y_fake"))
    return df.select(row_id).join(F.broadcast(top))  # one row


def compare(predictions: DataFrame, fake: DataFrame, row_id: str, names: list[str], t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Rows (metric, real, naive), both against the true values."""
    from lattica.functions.metrics import REGRESSION, complete

    both = predictions.join(fake, row_id)
    real, naive = complete(F.col(t), F.col(p)), complete(F.col(t), F.col("y_fake"))
    each = [F.struct(F.lit(n).alias("metric"), REGRESSION[n][1](*real).alias("real"), REGRESSION[n][1](*naive).alias("naive")).alias(n) for n in names]
    return both.agg(*each).select(F.inline(F.array(*names)))
