"""Kernel ridge regression and Gaussian processes of low rank, for tables of any size.

Rows are mapped to features of the kernel's span over a bounded set of landmark rows (Nystroem), and a model
is solved from sums of products of these features, taken once for all folds. With as many landmarks as
training rows the results are those of the exact solves, both the means and the deviations.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.workers import ship

from .neighbours import distances
from .sums import array_of, finite, matrix_sums

ship(__name__)

#: Landmarks if none are asked for, and the least noise.
LANDMARKS, LEAST = 256, 1e-10
#: Distinct rows of the features, for each fold, up to which each is worked on once and joined back by a broadcast.
PLACES = 50_000
#: What a landmark adds must be at least this share of the largest direction.
_RANK = 1e-12


def _rbf(a, b, length=1.0):
    return np.exp(-(distances(a, b) ** 2) / (2 * length**2))


def _matern(a, b, length=1.0):
    d = np.sqrt(3.0) * distances(a, b) / length
    return (1 + d) * np.exp(-d)


def _quadratic(a, b, length=1.0):
    return 1 / (1 + distances(a, b) ** 2 / (2 * length**2))


def _periodic(a, b, length=1.0):
    return np.exp(-2 * (np.sin(np.pi * distances(a, b)) / length) ** 2)


#: Kernels by name, with their usual parameters; `length` scales those that have one. ExpSineSquared is positive
#: definite for one feature only; with more, directions of negative weight are left out.
KERNELS = {
    "RBF": _rbf, "Matern": _matern, "RationalQuadratic": _quadratic, "ExpSineSquared": _periodic,
    "DotProduct": lambda a, b, length=1.0: 1 + a @ b.T, "ConstantKernel": lambda a, b, length=1.0: np.ones((len(a), len(b))),
}


class Kernel:
    """A kernel from a string of names joined by + and *, which apply from left to right without precedence.

    WhiteKernel is noise of variance 1: nothing between different rows. A minus has no meaning for
    kernels; what follows it is left out with a warning.
    """

    def __init__(self, text: str, length: float = 1.0):
        parts = re.split(r"([+*-])", text.replace(" ", ""))
        self.text, self.length, self.first, self.more = text, length, parts[0], []
        for sign, name in zip(parts[1::2], parts[2::2], strict=True):
            if sign == "-":
                warnings.warn(f"kernels can't be subtracted; {name} is left out", stacklevel=2)
            else:
                self.more.append((sign, name))
        for name in (self.first, *[n for _, n in self.more]):
            if name != "WhiteKernel" and name not in KERNELS:
                raise ValueError(f"no kernel {name!r}; there are WhiteKernel, {', '.join(KERNELS)}")

    def _fold(self, one) -> np.ndarray:
        out = one(self.first)
        for sign, name in self.more:
            out = out + one(name) if sign == "+" else out * one(name)
        return out

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The kernel between rows of a and rows of b, without noise."""
        return self._fold(lambda name: np.zeros((len(a), len(b))) if name == "WhiteKernel" else KERNELS[name](a, b, self.length))

    def diagonal(self, a: np.ndarray, white: float = 1.0) -> np.ndarray:
        """The kernel of each row with itself, with noise if white is 1."""
        own = lambda name: np.array([KERNELS[name](x[None], x[None], self.length)[0, 0] for x in a]) if name == "DotProduct" else np.ones(len(a))
        return self._fold(lambda name: np.full(len(a), white) if name == "WhiteKernel" else own(name))

    def noise(self, a: np.ndarray) -> np.ndarray:
        return self.diagonal(a) - self.diagonal(a, 0.0)


class Features:
    """phi(x) with phi(a) . phi(b) = the kernel of a and b, as far as the landmarks span it."""

    def __init__(self, kernel: Kernel, landmarks: np.ndarray):
        self.kernel, self.landmarks = kernel, landmarks
        values, vectors = np.linalg.eigh(kernel.cross(landmarks, landmarks))
        kept = values > _RANK * max(values.max(initial=0.0), 1e-300)
        self.root = vectors[:, kept] / np.sqrt(values[kept])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.cross(x, self.landmarks) @ self.root

    def products(self, x: np.ndarray, y: np.ndarray, alpha: float, n: np.ndarray | None = None, yy: np.ndarray | None = None) -> np.ndarray:
        """Weighted sums of products of (phi, y, 1), and a last row of plain sums: rows, y, log weights.

        n: how many rows each row of x stands for; y and yy are the sums of their values and squares then.
        """
        n, yy = np.ones(len(x)) if n is None else n, y * y if yy is None else yy
        weight = 1 / (alpha + self.kernel.noise(x))
        columns = np.column_stack([self(x), np.ones(len(x))])
        rank = columns.shape[1] - 1
        m = np.zeros((rank + 3, max(3, rank + 2)))
        at = np.append(np.arange(rank), rank + 1)
        m[np.ix_(at, at)] = (columns * (weight * n)[:, None]).T @ columns
        m[at, rank] = m[rank, at] = columns.T @ (weight * y)
        m[rank, rank] = weight @ yy
        m[-1, :3] = n.sum(), y.sum(), n @ np.log(weight)
        return m


class Model:
    """A solved model: the mean and the deviation at any row."""

    def __init__(self, features: Features, sums: np.ndarray, centre: bool = True):
        rank = features.root.shape[1]
        n, total, logs = sums[-1, :3]
        self.features, self.mean = features, (total / n if n and centre else 0.0)
        a = sums[:rank, :rank] + np.eye(rank)
        b = sums[:rank, rank] - self.mean * sums[:rank, rank + 1]
        self.lower = np.linalg.cholesky(a)
        self.coefficients = np.linalg.solve(a, b)
        yy = sums[rank, rank] - 2 * self.mean * sums[rank, rank + 1] + self.mean**2 * sums[rank + 1, rank + 1]
        # the log of the density of the training values, from the same sums
        self.log_likelihood = float(-0.5 * (yy - b @ self.coefficients) - np.log(np.diag(self.lower)).sum() + 0.5 * logs - 0.5 * n * np.log(2 * np.pi))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        phi = self.features(x)
        whitened = np.linalg.solve(self.lower, phi.T)
        variance = self.features.kernel.diagonal(x) - (phi * phi).sum(1) + (whitened * whitened).sum(0)
        return phi @ self.coefficients + self.mean, np.sqrt(np.maximum(variance, 0))


def landmarks(df: DataFrame, features: list[str], most: int = LANDMARKS) -> np.ndarray:
    """Up to `most` distinct rows of the features, those with the least hashes."""
    x = finite(df, features).select(array_of(features).alias("x")).distinct()
    return np.array([r.x for r in x.orderBy(F.xxhash64("x"), "x").limit(most).collect()], dtype=float).reshape(-1, len(features))


def _packed(df: DataFrame, features: list[str], **more: str) -> DataFrame:
    return finite(df, features).select(array_of(features).alias("x"), *[F.col(c).alias(name) for name, c in more.items()])


def few_places(df: DataFrame, features: list[str]) -> bool:
    """Whether the features have few distinct rows, by an approximate count."""
    return _packed(df, features).agg(F.approx_count_distinct(F.xxhash64("x"))).first()[0] <= PLACES


def sums_by(df: DataFrame, features: list[str], target: str, fold: str, maps: list[Features], alpha: float) -> list[dict]:
    """For each feature map {fold: sums}, from one scan of the data. Rows without a fold, feature or target are left out.

    Where the features have few distinct rows, those are summed up first.
    """
    rows = _packed(finite(df, [target]), features, y=target, fold=fold).where("fold is not null").withColumn("y", F.col("y").cast("double")).withColumn("fold", F.col("fold").cast("string"))
    if few_places(df, features):
        rows = rows.groupBy("fold", "x").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    else:
        rows = rows.select("fold", "x", F.lit(1.0).alias("n"), "y", (F.col("y") * F.col("y")).alias("yy"))

    def parts(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
        x, folds = np.stack(pdf["x"].to_numpy()).astype(float), pdf["fold"].to_numpy()
        n, y, yy = (pdf[c].to_numpy(dtype=float) for c in ("n", "y", "yy"))
        for k in np.unique(folds.astype(str)):
            own = folds == k
            for i, m in enumerate(maps):
                products = m.products(x[own], y[own], alpha, n[own], yy[own])
                yield f"{i}|{k}", np.pad(products, ((0, 0), (0, width - products.shape[1])))

    width = max(max(3, m.root.shape[1] + 2) for m in maps)
    out: list[dict] = [{} for _ in maps]
    for key, m in matrix_sums(rows, "string", parts).items():
        i, k = key.split("|", 1)
        out[int(i)][k] = m[:, : max(3, maps[int(i)].root.shape[1] + 2)]
    return out


def fit(train: DataFrame, features: list[str], target: str, kernel: str = "RBF", alpha: float = LEAST, most: int = LANDMARKS, lengths: tuple[float, ...] = (1.0,), centre: bool = True) -> Model:
    """The model of the length that makes the training values likeliest; all lengths share one scan.

    kernel: a string as Kernel takes. alpha is added to the kernel's own noise. Memory is of the square
    of `most`, on the driver and in tasks.
    """
    z = landmarks(train, features, most)
    maps = [Features(Kernel(kernel, length), z) for length in lengths]
    found = sums_by(train.withColumn("__fold", F.lit("all")), features, target, "__fold", maps, max(alpha, LEAST))
    models = [Model(m, s["all"], centre) for m, s in zip(maps, found, strict=True) if s]
    if not models:
        raise ValueError("no complete training row")
    return max(models, key=lambda m: m.log_likelihood)


def _predicted(rows: DataFrame, models: dict, names: dict[str, str], few: bool) -> DataFrame:
    """Rows (names..., y_pred, y_err) of rows (x, fold, names...), by the model of their fold.

    few: the features have few distinct rows; each of them is predicted once for a fold.
    """
    if few:
        places = rows.select(F.col("x").alias("__x"), F.col("fold").alias("__k")).distinct().select("__x", "__k", F.col("__x").alias("x"), F.col("__k").alias("fold"))
        found = F.broadcast(_predicted(places, models, {"__x": "x", "__k": "fold"}, False))  # PLACES rows a fold, about
        return rows.join(found, ["x", "fold"], "left").select(*[F.col(n).alias(c) for n, c in names.items()], "y_pred", "y_err")
    kinds = dict(rows.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mean, deviation = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            x, folds = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1)), pdf["fold"].to_numpy()
            for k in set(folds):
                if k in models:
                    own = folds == k
                    mean[own], deviation[own] = models[k].predict(x[own])
            yield pdf[list(names)].assign(y_pred=mean, y_err=deviation)

    out = rows.mapInPandas(work, ", ".join(f"{n} {kinds[n]}" for n in names) + ", y_pred double, y_err double")
    return out.select(*[F.col(n).alias(c) for n, c in names.items()], *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("y_pred", "y_err")])


def predict(df: DataFrame, model: Model, row_id: str, features: list[str]) -> DataFrame:
    """Rows (row_id, y_pred, y_err) of the rows that miss no feature."""
    return _predicted(_packed(df, features, __r=row_id).withColumn("fold", F.lit("all")), {"all": model}, {"__r": row_id}, few_places(df, features))


def cross_validated(df: DataFrame, row_id: str, features: list[str], target: str, fold: str, kernel: str = "RBF", alpha: float = LEAST, most: int = LANDMARKS, length: float = 1.0, centre: bool = True) -> DataFrame:
    """Rows (fold, row_id, y_pred, y_err): each row by the model that is trained on the other folds.

    Sums are taken once per fold, and train = total - fold. Landmarks come from all rows: they span the
    features and say nothing of the target. Rows that miss a feature are left out, rows without a target
    are predicted only.
    """
    maps = [Features(Kernel(kernel, length), landmarks(df, features, most))]
    sums = sums_by(df, features, target, fold, maps, max(alpha, LEAST))[0]
    total = sum(sums.values()) if sums else None
    rows = _packed(df, features, __r=row_id, __f=fold).withColumn("fold", F.col("__f").cast("string"))
    ids = [r[0] for r in df.select(F.col(fold).cast("string")).distinct().collect() if r[0] is not None]  # as many as folds
    models = {k: Model(maps[0], total - sums[k] if k in sums else total, centre) for k in ids if total is not None and total[-1, 0] > (sums[k][-1, 0] if k in sums else 0)}
    return _predicted(rows, models, {"__f": fold, "__r": row_id}, few_places(df, features))


def kernel_ridge(df: DataFrame, row_id: str, features: list[str], target: str, fold: str, gamma: float = 1.0, alpha: float = 1.0, most: int = LANDMARKS) -> DataFrame:
    """Cross-validated kernel ridge regression with exp(-gamma d^2); the deviation is that of a Gaussian process with the same kernel."""
    return cross_validated(df, row_id, features, target, fold, "RBF", alpha, most, 1 / np.sqrt(2 * gamma))
