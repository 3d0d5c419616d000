"""Experiments: models x selectors x splits as one long table of scores, with what they share computed once.

All linear members, whatever their penalties and selectors, are trained and scored from the sums of products of
each fold, which take one scan of the data. Other members get the same folds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import metrics as mt
from lattica.functions.order import hash_number
from lattica.operators import kernels, models, neighbours, trees
from lattica.operators.sums import finite

from .dataset import Dataset

#: Metrics that follow from sums of products.
FROM_SUMS = ("mean_squared_error", "root_mean_squared_error", "r2_score")


@dataclass(frozen=True)
class Linear:
    """Least squares; alpha penalises squares, or with l1_ratio as an elastic net does (1: lasso)."""

    alpha: float = 0.0
    l1_ratio: float | None = None

    def fit(self, m: np.ndarray) -> np.ndarray:
        return models.solve(m, self.alpha) if self.l1_ratio is None else models.solve_elastic(m, self.alpha, self.l1_ratio)


@dataclass(frozen=True)
class Other:
    """A model of another kind: work(train, test, row_id, features, target) gives rows (row_id, y_pred)."""

    work: Callable[[DataFrame, DataFrame, str, list[str], str], DataFrame]


def forest(**options) -> Other:
    return Other(lambda train, test, row_id, features, target: trees.predict(test, trees.random_forest(train, row_id, features, target, **options)).select(row_id, "y_pred"))


def extra_trees(**options) -> Other:
    return Other(lambda train, test, row_id, features, target: trees.predict(test, trees.extra_trees(train, row_id, features, target, **options)).select(row_id, "y_pred"))


def ada_boost(**options) -> Other:
    return Other(lambda train, test, row_id, features, target: trees.predict(test, trees.ada_boost(train, row_id, features, target, **options)).select(row_id, "y_pred"))


def gaussian_process(**options) -> Other:
    return Other(lambda train, test, row_id, features, target: kernels.predict(test, kernels.fit(train, features, target, **options), row_id, features).select(row_id, "y_pred"))


def nearest(k: int = 5, metric: str = "euclidean") -> Other:
    return Other(lambda train, test, row_id, features, target: models.knn_regress(neighbours.nearest(test, train, row_id, features, target, k, metric), row_id))


# ---------------------------------------------------------------- selectors, from a training matrix of sums
Selector = Callable[[np.ndarray], list[int]]


def all_features(m: np.ndarray) -> list[int]:
    return list(range(len(m) - 2))


def _centred(m: np.ndarray) -> np.ndarray:
    mean = m[0, 1:] / m[0, 0]
    return m[1:, 1:] / m[0, 0] - np.outer(mean, mean)


def best_correlated(n: int) -> Selector:
    """The n features with the greatest correlation with the target, in size; ties to the first. The order of F scores is the same."""

    def select(m: np.ndarray) -> list[int]:
        c = _centred(m)
        d = np.sqrt(np.maximum(np.diag(c), 0))
        r = np.abs(c[:-1, -1]) / np.where(d[:-1] * d[-1] == 0, 1, d[:-1] * d[-1])
        return sorted(sorted(range(len(r)), key=lambda i: (-r[i], i))[:n])

    return select


def varying(least: float = 0.0) -> Selector:
    """Features with a variance above `least`."""
    return lambda m: [i for i, v in enumerate(np.diag(_centred(m))[:-1]) if v > least]


def forward(n: int) -> Selector:
    """n features, each the one whose addition lessens the training error of least squares most."""

    def select(m: np.ndarray) -> list[int]:
        chosen: list[int] = []
        while len(chosen) < min(n, len(m) - 2):
            chosen.append(min((i for i in range(len(m) - 2) if i not in chosen), key=lambda i: (scores(m, models.solve(part(m, [*chosen, i])), [*chosen, i])["mean_squared_error"], i)))
        return sorted(chosen)

    return select


def part(m: np.ndarray, chosen: list[int]) -> np.ndarray:
    """The sums of some features."""
    at = [0, *[i + 1 for i in chosen], len(m) - 1]
    return m[np.ix_(at, at)]


def scores(m: np.ndarray, beta: np.ndarray, chosen: list[int]) -> dict[str, float]:
    """FROM_SUMS of a model over the rows whose sums are in m."""
    p, v = part(m, chosen), np.append(beta, -1.0)
    n = float(p[0, 0])
    error = max(float(v @ p @ v), 0.0)
    spread = float(p[-1, -1] - p[0, -1] ** 2 / n)
    return {"mean_squared_error": error / n, "root_mean_squared_error": (error / n) ** 0.5, "r2_score": 1 - error / spread if spread > 0 else None}


# ---------------------------------------------------------------- the experiment
@dataclass
class Experiment:
    """Members and folds; `run` gives rows (model, selector, split, metric, value)."""

    data: Dataset
    models: dict[str, Linear | Other]
    selectors: dict[str, Selector] = field(default_factory=lambda: {"all": all_features})
    metrics: tuple[str, ...] = ("root_mean_squared_error", "r2_score")
    k: int = 5

    def folded(self) -> DataFrame:
        """The complete rows with their fold."""
        d = self.data
        return finite(d.projected(), [*d.features, d.target]).withColumn("fold", (hash_number(d.row_id) % self.k).cast("int"))

    def sums(self) -> dict[int, np.ndarray]:
        """The folds' sums of products: features squared numbers a fold come to the driver."""
        d = self.data
        return {r.fold: models._matrix(r, len(d.features) + 2) for r in models.gram(self.folded(), d.features, d.target, ["fold"]).collect()}

    def run(self) -> DataFrame:
        d, spark = self.data, self.data.df.sparkSession
        parts = self.sums()
        total = sum(parts.values(), np.zeros((len(d.features) + 2,) * 2))
        chosen = {(s, k): select(total - m) for s, select in self.selectors.items() for k, m in parts.items() if (total - m)[0, 0] > 0}
        fitted = {(name, s, k): model.fit(part(total - parts[k], own)) for name, model in self.models.items() if isinstance(model, Linear) for (s, k), own in chosen.items()}
        rows = [(name, s, k, metric, scores(parts[k], beta, chosen[s, k])[metric]) for (name, s, k), beta in fitted.items() for metric in self.metrics if metric in FROM_SUMS]
        out = spark.createDataFrame(rows, "model string, selector string, split int, metric string, value double")
        rest = [x for x in self.metrics if x not in FROM_SUMS]
        if rest and fitted:
            out = out.unionByName(self._scored(self._linear_predictions(fitted, chosen), rest))
        for name, model in self.models.items():
            if isinstance(model, Other):
                for (s, k), own in chosen.items():
                    out = out.unionByName(self._scored(self._other_predictions(name, model, s, k, [d.features[i] for i in own]), list(self.metrics)))
        return out

    def _linear_predictions(self, fitted: dict, chosen: dict) -> DataFrame:
        """Rows (model, selector, split, y_true, y_pred) of all linear members, from one scan."""
        d = self.data
        rows = []
        for (name, s, k), beta in fitted.items():
            full = np.zeros(len(d.features) + 1)
            full[[0, *[i + 1 for i in chosen[s, k]]]] = beta
            rows.append((k, name, s, full.tolist()))
        table = d.df.sparkSession.createDataFrame(rows, "fold int, model string, selector string, b array<double>").groupBy("fold").agg(F.collect_list(F.struct("model", "selector", "b")).alias("__m"))
        each = self.folded().join(F.broadcast(table), "fold").select(F.col("fold").alias("split"), F.col(d.target).cast("double").alias("y_true"), *d.features, F.explode("__m").alias("m"))  # a row per fold
        y = F.get("m.b", F.lit(0))
        for i, c in enumerate(d.features):
            y = y + F.get("m.b", F.lit(i + 1)) * F.col(c)
        return each.select("m.model", "m.selector", "split", "y_true", y.alias("y_pred"))

    def _other_predictions(self, name: str, model: Other, selector: str, k: int, features: list[str]) -> DataFrame:
        d, rows = self.data, self.folded()
        test = rows.where(F.col("fold") == k)
        predicted = model.work(rows.where(F.col("fold") != k), test, d.row_id, features, d.target)
        return test.select(d.row_id, F.col(d.target).cast("double").alias("y_true")).join(predicted, d.row_id).select(F.lit(name).alias("model"), F.lit(selector).alias("selector"), F.lit(k).alias("split"), "y_true", "y_pred")

    def _scored(self, predictions: DataFrame, names: list[str]) -> DataFrame:
        by = ["model", "selector", "split"]
        return mt.evaluate(predictions, names, by).unpivot(by, names, "metric", "value")


def summary(scored: DataFrame) -> DataFrame:
    """Rows (model, selector, metric, mean, stdev) over the splits."""
    return scored.groupBy("model", "selector", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("stdev"))


def best_members(scored: DataFrame, metric: str) -> DataFrame:
    """One row (model, selector, mean) for each model: its best selector by the metric, ties to the first name."""
    sign = -1.0 if mt.REGRESSION[metric][0] else 1.0
    means = summary(scored).where(F.col("metric") == metric)
    return means.groupBy("model").agg(F.min(F.struct((F.lit(sign) * F.col("mean")).alias("o"), "selector", "mean")).alias("b")).select("model", "b.selector", "b.mean")


def halving(df: DataFrame, row_id: str, candidates: list[dict], score: Callable[[DataFrame, dict], float], eta: int = 3, least: int = 1000, seed: int = 0) -> list[tuple[dict, int, float]]:
    """(candidate, round, score) of successive halving (Jamieson and Talwalkar 2016); the last is the best. Least scores win.

    Round r scores the candidates that are left on a share of the rows, by a hash of their ids, which
    grows eta-fold a round to the whole table; the best 1 / eta of them go on. The shares are such that the
    last round has eta candidates at most, and no round less than `least` rows where the table has
    them.
    """
    rows, out, left = df.count(), [], list(candidates)
    rounds = max(1, int(np.ceil(np.log(max(len(left), 1)) / np.log(eta))))
    for r in range(rounds):
        share = min(1.0, max(float(eta) ** (r + 1 - rounds), least / max(rows, 1)))
        own = df if share >= 1 else df.where(hash_number(row_id, seed=f"halving{seed}") < int(share * 2**32))
        found = sorted(((score(own, c), i) for i, c in enumerate(left)))
        out += [(left[i], r, s) for s, i in reversed(found)]
        left = [left[i] for _, i in found[: max(1, len(left) // eta if r + 1 < rounds else 1)]]
    return out
