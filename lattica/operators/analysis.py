"""The tables behind diagnostic plots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.metrics import REGRESSION, evaluate
from lattica.functions.order import running

from .cleaning import describe


def best_and_worst_split(df: DataFrame, by: str = "split", metric: str = "root_mean_squared_error") -> DataFrame:
    """Rows (which, split, value); ties go to the lesser split."""
    per = evaluate(df, [metric], [by])
    sign = -1 if REGRESSION[metric][0] else 1
    order = lambda s: F.struct((s * F.col(metric)).alias("o"), F.col(by).alias("b"), F.col(metric).alias("v"))
    both = per.agg(F.min(order(sign)).alias("best"), F.min(order(-sign)).alias("worst"))
    return both.select(F.inline(F.array(*[F.struct(F.lit(w).alias("which"), F.col(f"{w}.b").alias(by), F.col(f"{w}.v").alias("value")) for w in ("best", "worst")])))


def best_and_worst_prediction(df: DataFrame, row_id: str, by: str = "split", t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Rows (row_id, y_true, best, worst): predictions with the least and the greatest residual over splits."""
    gap = F.abs(F.col(p) - F.col(t))
    return df.groupBy(row_id, t).agg(F.min_by(F.col(p), F.struct(gap, by)).alias("best"), F.max_by(F.col(p), F.struct(gap, -F.col(by))).alias("worst"))


def mean_prediction(df: DataFrame, row_id: str, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Rows (row_id, y_true, mean, stdev, n); sample deviations, null for a single prediction."""
    return df.groupBy(row_id, t).agg(F.avg(p).alias("mean"), F.stddev_samp(p).alias("stdev"), F.count("*").alias("n"))


def bin_count(n: int) -> int:
    """Bins of a histogram for n values."""
    return max(1, min(100, math.ceil(math.sqrt(n))))


def histogram(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Rows (bin, low, high, n), empty bins left out; bins of equal width, the last one closed."""
    if n is None:
        n = bin_count(df.select(column).where(F.col(column).isNotNull()).count())
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(n - 1))).otherwise(0)
    counted = df.where(F.col(column).isNotNull()).join(F.broadcast(span)).groupBy(at.cast("int").alias("bin"), "lo", width.alias("w")).agg(F.count("*").alias("n"))  # one row
    return counted.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def summary(df: DataFrame, column: str) -> DataFrame:
    return describe(df, [column])


def feature_occurrence(chosen: DataFrame) -> DataFrame:
    """chosen: (split, feature, score). Rows (feature, occurrences, mean, stdev)."""
    return chosen.groupBy("feature").agg(F.count("*").alias("occurrences"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("stdev"))


def quantile_pairs(df: DataFrame, r: str, points: int = 99) -> DataFrame:
    """Rows (level, sample): exact quantiles of r, to set against a normal distribution's."""
    levels = [i / (points + 1) for i in range(1, points + 1)]
    got = df.agg(F.percentile(r, F.array(*[F.lit(x) for x in levels])).alias("q"))
    return got.select(F.inline(F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias("level"), F.col("q").alias("sample"))))


def running_share(df: DataFrame, value: str) -> DataFrame:
    """Rows (value, share): the empirical distribution function over distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    below = running(counts, [value], {"__below": F.col("n")}).join(F.broadcast(total))  # one row
    return below.select(value, ((F.col("__below") + F.col("n")) / F.col("__total")).alias("share"))
