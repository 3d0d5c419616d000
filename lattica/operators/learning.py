"""Learning curves of linear models, from sums per (size, fold) or from prefixes of one matrix of sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.metrics import REGRESSION
from lattica.functions.order import hash_number

from .models import _matrix, gram, solve

SIZES = (0.1, 0.325, 0.55, 0.775, 1.0)


def data_curve(df: DataFrame, row_id: str, features: list[str], target: str, k: int = 5, sizes: tuple[float, ...] = SIZES, metric: str = "mean_absolute_error") -> DataFrame:
    """Rows (size, part, mean, stdev): scores on training and test rows, over k folds.

    A training set of size s holds the rows whose hash is below s, so larger sets hold the smaller.
    One job takes the sums per fold and size band, one scores all models.
    """
    u = hash_number(row_id, seed="size") / F.lit(4294967296.0)
    band = F.lit(len(sizes))
    for i, s in reversed(list(enumerate(sizes))):
        band = F.when(u < s, F.lit(i)).otherwise(band)
    base = df.select(row_id, *features, target, (hash_number(row_id, seed="fold") % k).cast("int").alias("fold"), band.alias("band"))
    rows = gram(base, features, target, ["fold", "band"]).collect()
    width = len(features) + 2
    models = []
    for i, s in enumerate(sizes):
        for fold in range(k):
            m = sum((_matrix(r, width) for r in rows if r.fold != fold and r.band <= i), np.zeros((width, width)))
            if m[0, 0] > 0:
                models.append((float(s), i, fold, *map(float, solve(m))))
    table = df.sparkSession.createDataFrame(models, "size double, step int, model int, " + ", ".join(f"b{j} double" for j in range(width - 1)))
    y = F.col("b0")
    for j, c in enumerate(features):
        y = y + F.col(f"b{j + 1}") * F.col(c)
    each = table.agg(F.collect_list(F.struct(*table.columns)).alias("m"))
    scored = base.join(F.broadcast(each)).select("fold", "band", target, *features, F.inline("m")).withColumn("p", y)  # one row of len(sizes) * k models
    part = F.when(F.col("fold") == F.col("model"), "test").when(F.col("band") <= F.col("step"), "train")
    per = scored.withColumn("part", part).where("part is not null").groupBy("size", "part", "model").agg(REGRESSION[metric][1](F.col(target), F.col("p")).alias("s"))
    return per.groupBy("size", "part").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("stdev"))


def feature_curve(df: DataFrame, features: list[str], target: str, fold: str) -> DataFrame:
    """Rows (n_features, part, mean, stdev): RMSE with the first n features, from one aggregation."""
    rows = gram(df, features, target, [fold]).collect()
    parts = [_matrix(r, len(features) + 2) for r in rows]
    total = sum(parts)
    out = []
    for n in range(1, len(features) + 1):
        pick = np.ix_([0, *range(1, n + 1), len(features) + 1], [0, *range(1, n + 1), len(features) + 1])
        scores = {"train": [], "test": []}
        for m in parts:
            v = np.concatenate([solve((total - m)[pick]), [-1.0]])
            for name, x in (("train", (total - m)[pick]), ("test", m[pick])):
                scores[name].append(float(np.sqrt(max(v @ x @ v, 0) / x[0, 0])))
        out += [(n, name, float(np.mean(s)), float(np.std(s))) for name, s in scores.items()]
    return df.sparkSession.createDataFrame(out, "n_features int, part string, mean double, stdev double")


def both(data: DataFrame, features: DataFrame) -> DataFrame:
    """Rows (curve, x, part, mean, stdev) of a curve over sizes and one over numbers of features."""
    rows = ["part", "mean", "stdev"]
    first = data.select(F.lit("data").alias("curve"), F.col("size").alias("x"), *rows)
    return first.unionByName(features.select(F.lit("features").alias("curve"), F.col("n_features").cast("double").alias("x"), *rows))
