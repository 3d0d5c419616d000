"""Domains by dissimilarity: how far from its training data a model's errors and error bars can be trusted.

Rows are predicted by models that were trained on other random folds, and on other clusters, which are further away. Their
dissimilarity from what each model was trained on is binned; bins with small errors, or with well calibrated error
bars, are inside, and the threshold that tells inside from outside best is kept. (Schultz et al. 2025.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.order import hash_number
from lattica.functions.scratch import Kept
from lattica.operators import neighbours, splits, trees, uncertainty
from lattica.operators.domain import threshold_by_f1
from lattica.operators.scaling import Scaler
from lattica.operators.sums import array_of, finite

from .dataset import Dataset


def by_bins(scored: DataFrame, bins: int = 10, most_rmse: float = 1.0, most_area: float = 0.1) -> DataFrame:
    """Rows (bin, n, least, most, rmse, area, inside_error, inside_area) by dissimilarity in bins of equal counts.

    scored: (y_true, residual, y_err, dissimilarity). rmse is over the deviation of all true values; area is the
    miscalibration area of residual over error bar, without error bars of 0.
    """
    binned = uncertainty.error_bins(scored, bins, True, "dissimilarity")
    spread = scored.agg(F.stddev_pop("y_true").alias("__s"))
    rmse = binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("dissimilarity").alias("least"), F.max("dissimilarity").alias("most"), F.sqrt(F.avg(F.pow("residual", F.lit(2)))).alias("__r"))
    area = uncertainty.miscalibration_area(uncertainty.calibration_curve(uncertainty.r_statistic(binned), by=["bin"]), by=["bin"])
    both = rmse.join(area, "bin", "left").join(F.broadcast(spread))  # as many rows as bins, and one
    out = both.withColumn("rmse", F.col("__r") / F.nullif("__s", F.lit(0.0)))
    inside = lambda c, most: F.coalesce(F.col(c) <= most, F.lit(False)).cast("int")
    return out.select("bin", "n", "least", "most", "rmse", "area", inside("rmse", most_rmse).alias("inside_error"), inside("area", most_area).alias("inside_area"))


def thresholds(scored: DataFrame, judged: DataFrame) -> dict[str, tuple[float, float]]:
    """{"residual", "uncertainty"}: the dissimilarity up to which rows count as inside, with the greatest F1, and that F1."""
    edges = F.broadcast(judged.select("least", "most", "inside_error", "inside_area"))  # as many rows as bins
    labelled = scored.join(edges, F.col("dissimilarity").between(F.col("least"), F.col("most"))).select("dissimilarity", "inside_error", "inside_area")
    return {name: threshold_by_f1(labelled, "dissimilarity", c) for name, c in (("residual", "inside_error"), ("uncertainty", "inside_area"))}


@dataclass
class Applicability:
    """A fitted model with its domain: `predict` marks each row as inside or outside by both criteria."""

    data: Dataset
    scaler: Scaler
    forest: trees.Forest
    calibration: list[float]
    bandwidth: float
    densest: float
    limits: dict[str, tuple[float, float]]
    bins: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows (row_id, y_pred, y_err, dissimilarity, domain_residual, domain_uncertainty); domains are 1 inside, -1 outside."""
        d = self.data
        scaled = self.scaler.transform(finite(df, d.features))
        train = self.scaler.transform(finite(d.projected(), [*d.features, d.target]))
        density = neighbours.density(scaled, train, d.row_id, d.features, self.bandwidth)
        far = (1 - F.col("density") / F.lit(self.densest)).alias("dissimilarity")
        predicted = trees.predict(scaled, self.forest).select(d.row_id, "y_pred", uncertainty.recalibrated(F.col("y_err"), [F.lit(a) for a in self.calibration]).alias("y_err"))
        side = lambda name: F.when(F.col("dissimilarity") <= self.limits[name][0], 1).otherwise(-1).alias(f"domain_{name}")
        return predicted.join(density.select(d.row_id, far), d.row_id).select("*", side("residual"), side("uncertainty"))


def _places(df: DataFrame, conditions: list[Column], bandwidth: float) -> tuple[DataFrame, list[float]]:
    """Rows (x, densities) of the distinct places x of df, and the greatest density among each training part.

    conditions: of each training part, whether a row belongs to it. Kernels between places are measured once for all parts.
    """
    counts = [F.count_if(c).cast("double") for c in conditions]
    places = Kept(df.groupBy("x").agg(F.array(*counts).alias("weights")).select(F.monotonically_increasing_id().alias("id"), "x", "weights"), "places")
    every = range(len(conditions))
    n = places.df.agg(*[F.sum(F.get("weights", F.lit(i))).alias(f"n{i}") for i in every]).first()
    sums = neighbours.kernel_sums(places.df, places.df, len(conditions), bandwidth)
    each = [F.coalesce(F.get("sums", F.lit(i)), F.lit(0.0)) / F.lit(n[i]) for i in every]
    found = Kept(places.df.join(sums, "id", "left").select("x", "weights", F.array(*each).alias("densities")), "densities")
    top = found.df.agg(*[F.max(F.when(F.get("weights", F.lit(i)) > 0, F.get("densities", F.lit(i)))).alias(f"t{i}") for i in every]).first()
    places.drop()
    return found.df.select("x", "densities"), list(top)


def fit(data: Dataset, k: int = 5, n_clusters: tuple[int, ...] = (2, 3), bandwidth: float = 1.0, n_trees: int = 10, depth: int = 5, bins: int = 10, most_rmse: float = 1.0, most_area: float = 0.1, cluster: str = "KMeans") -> Applicability:
    """Grow the forest, calibrate its error bars on random folds, and find both thresholds on random folds and cluster folds.

    bandwidth is of the standardized features' kernel density. Rows that miss a feature or the target are left out.
    """
    rows = finite(data.projected(), [*data.features, data.target])
    scaler = Scaler("StandardScaler").fit(rows, data.features)
    df = scaler.transform(rows)
    kinds, folded = ["random", *[f"clusters_{n}" for n in n_clusters]], df.withColumn("__fold0", (hash_number(data.row_id) % k).cast("int"))
    for i, n in enumerate(n_clusters, 1):
        folds = splits.cluster_folds(df, data.row_id, data.features, n, cluster)
        folded = folded.join(folds.withColumnRenamed("fold", f"__fold{i}"), data.row_id)
    # all that follows reads this table: rows with a fold of every kind, and their place
    table = Kept(folded.select(data.row_id, *data.features, data.target, array_of(data.features).alias("x"), *[f"__fold{i}" for i in range(len(kinds))]), "folds")
    values = table.df.agg(*[F.sort_array(F.collect_set(f"__fold{i}")).alias(kind) for i, kind in enumerate(kinds)]).first()  # as many as folds
    parts = [(i, fold) for i, kind in enumerate(kinds) for fold in values[kind] if len(values[kind]) > 1]
    conditions = [*[F.col(f"__fold{i}") != fold for i, fold in parts], F.lit(True)]
    places, top = _places(table.df, conditions, bandwidth)
    *forests, forest = trees.random_forests(table.df, data.row_id, data.features, data.target, conditions, n_trees, depth)
    placed, out = Kept(table.df.join(places, "x"), "placed"), None
    for j, (i, fold) in enumerate(parts):  # each fold by what the others give
        far = (1 - F.get("densities", F.lit(j)) / F.lit(top[j])).alias("dissimilarity")
        tested = trees.predict(placed.df.where(F.col(f"__fold{i}") == fold), forests[j])
        one = tested.select(F.lit(kinds[i]).alias("kind"), F.lit(int(fold)).alias("fold"), F.col(data.row_id), F.col(data.target).cast("double").alias("y_true"), "y_pred", "y_err", far)
        out = one if out is None else out.unionByName(one)
    scored = Kept(out.withColumn("residual", F.col("y_pred") - F.col("y_true")), "scored")
    calibration = uncertainty.calibrate(scored.df.where("kind = 'random' and y_err > 0"))
    calibrated = scored.df.withColumn("y_err", uncertainty.recalibrated(F.col("y_err"), [F.lit(a) for a in calibration]))
    judged = Kept(by_bins(calibrated, bins, most_rmse, most_area), "judged")
    limits = thresholds(calibrated, judged.df)
    for kept in (scored, placed, table):
        kept.drop()
    return Applicability(data, scaler, forest, calibration, bandwidth, top[-1], limits, judged.df)
