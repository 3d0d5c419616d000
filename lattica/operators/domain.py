"""Applicability domains: whether a row lies where the training data are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbours


def elemental(test_parts: DataFrame, train_parts: DataFrame, formula: str) -> DataFrame:
    """Rows (formula, domain): 1 if training has all of a formula's elements, 0 some, -1 none."""
    seen = train_parts.select("element").distinct().withColumn("__seen", F.lit(1))  # 118 rows at most
    flag = F.coalesce("__seen", F.lit(0))
    both = test_parts.join(F.broadcast(seen), "element", "left").groupBy(formula).agg(F.min(flag).alias("lo"), F.max(flag).alias("hi"))
    return both.select(formula, F.when(F.col("lo") == 1, 1).when(F.col("hi") == 1, 0).otherwise(-1).alias("domain"))


def feature_range(test: DataFrame, train: DataFrame, row_id: str, features: list[str]) -> DataFrame:
    """Rows (row_id, n_inside, outside): features between training's minimum and maximum, and the others' names."""
    spans = train.agg(*[f(c).alias(f"{k}_{c}") for c in features for k, f in (("lo", F.min), ("hi", F.max))])
    names = F.array(*[F.when(F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}")), F.lit(None)).otherwise(F.lit(c)) for c in features])
    wide = test.select(row_id, *features).join(F.broadcast(spans))  # one row
    return wide.withColumn("__out", F.array_compact(names)).select(row_id, (F.lit(len(features)) - F.size("__out")).alias("n_inside"), F.array_join("__out", ", ").alias("outside"))


def by_error(df: DataFrame, train_errors: DataFrame, sigma: str = "y_err") -> DataFrame:
    """df with domain 1 where sigma is at most the greatest of cross-validated training, else -1."""
    most = train_errors.agg(F.max(sigma).alias("__most"))
    return df.join(F.broadcast(most)).withColumn("domain", F.when(F.col(sigma) <= F.col("__most"), 1).otherwise(-1)).drop("__most")  # one row


def dissimilarity(test: DataFrame, train: DataFrame, row_id: str, features: list[str], bandwidth: float = 1.0) -> DataFrame:
    """Rows (row_id, density, dissimilarity): Gaussian kernel density of training at a row, and 1 - density / greatest training density.

    The greatest density is that of training rows among themselves.
    """
    top = neighbours.density(train, train, row_id, features, bandwidth).agg(F.max("density").alias("__top"))
    own = neighbours.density(test, train, row_id, features, bandwidth)
    return own.join(F.broadcast(top)).select(row_id, "density", (1 - F.col("density") / F.col("__top")).alias("dissimilarity"))  # one row


def threshold_by_f1(scored: DataFrame, score: str, inside: str, points: int = 101) -> tuple[float, float]:
    """(threshold, F1) of the rule score <= threshold for a 0/1 truth, over a grid of the score's range."""
    row = scored.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    grid = [row.lo + (row.hi - row.lo) * i / (points - 1) for i in range(points)]
    # a row counts from the first threshold on that is not below its score; one count for each threshold comes to the driver
    first = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g < F.col(score)))
    hit, all_, truth = np.zeros(points), np.zeros(points), 0
    for r in scored.groupBy(F.when(F.col(score).isNotNull(), first).alias("i")).agg(F.count("*").alias("n"), F.sum(inside).alias("h")).collect():
        truth += r.h or 0
        if r.i is not None and r.i < points:
            hit[r.i], all_[r.i] = r.h or 0, r.n
    f1 = 2 * np.cumsum(hit) / np.maximum(np.cumsum(all_) + truth, 1)
    best = int(np.argmax(f1))
    return grid[best], float(f1[best])


def by_threshold(df: DataFrame, score: str, most: float) -> DataFrame:
    return df.withColumn("domain", F.when(F.col(score) <= most, 1).otherwise(-1))
