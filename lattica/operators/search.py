"""Hyper-parameter search over cross-validated linear models and pyspark.ml estimators."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import _matrix, gram, solve

_CASTS = {"int": lambda x: int(float(x)), "float": float, "str": str, "tup": lambda x: tuple(int(v) for v in x.strip("()").split(",") if v)}


def parse_space(names: str, values: str) -> dict[str, list]:
    """Search spaces from two texts: parameters are separated by ';', a parameter's values by spaces.

    The last word is the type (int, float, str, tup). 'low high n lin' or 'low high n log' before it
    stand for n values from low to high, evenly or by even exponents of ten.
    """
    keys, specs = ([x.strip() for x in t.split(";") if x.strip()] for t in (names, values))
    if len(keys) != len(specs):
        raise ValueError(f"{len(keys)} names and {len(specs)} lists of values")
    out = {}
    for key, spec in zip(keys, specs, strict=True):
        *words, kind = spec.split()
        if kind not in _CASTS:
            raise ValueError(f"no type {kind!r}; there are {', '.join(_CASTS)}")
        if len(words) == 4 and words[3] in ("lin", "log"):
            low, high, n = float(words[0]), float(words[1]), int(words[2])
            grid = np.linspace(low, high, n) if words[3] == "lin" else np.logspace(low, high, n)
            out[key] = [_CASTS[kind](x) for x in grid]
        else:
            out[key] = [_CASTS[kind](w) for w in words]
    return out


def combinations(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]


def count_combinations(space: dict[str, list]) -> int:
    return int(np.prod([len(v) for v in space.values()])) if space else 0


def sampled(space: dict[str, list | Callable[[random.Random], object]], n: int, seed: int = 0) -> list[dict]:
    """n random candidates: lists are chosen from, functions are called with the generator."""
    r = random.Random(seed)
    return [{k: v(r) if callable(v) else r.choice(v) for k, v in space.items()} for _ in range(n)]


def ridge_scores(df: DataFrame, features: list[str], target: str, fold: str, alphas: list[float]) -> DataFrame:
    """Rows (alpha, fold, mse) for every candidate, from one pass over the table."""
    rows = gram(df, features, target, [fold]).collect()
    parts = {r[fold]: _matrix(r, len(features) + 2) for r in rows}
    total = sum(parts.values())
    out = []
    for a in alphas:
        for k, m in parts.items():
            v = np.concatenate([solve(total - m, a), [-1.0]])
            out.append((float(a), k, float(max(v @ m @ v, 0) / m[0, 0])))
    return df.sparkSession.createDataFrame(out, f"alpha double, `{fold}` {dict(df.dtypes)[fold]}, mse double")


def summarize(scores: DataFrame, candidate: str, score: str) -> DataFrame:
    """Rows (candidate, mean_score, std_score, rank)."""
    from pyspark.sql import Window

    per = scores.groupBy(candidate).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mean_score", candidate)))


def best(summary: DataFrame, candidate: str):
    return summary.orderBy("mean_score", candidate).first()[candidate]


def cross_validated(df: DataFrame, features: list[str], target: str, fold: str, name: str, candidates: list[dict], metric: str = "mean_absolute_error") -> list[tuple[dict, float, float]]:
    """(candidate, mean, deviation) of a pyspark.ml model over the folds of a column; the table is cached once."""
    from lattica.functions.metrics import REGRESSION

    from .models import fit

    df = df.cache()
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    out = []
    for c in candidates:
        scores = []
        for k in folds:
            model = fit(df.where(F.col(fold) != k), features, target, name, **c)
            scores.append(model.transform(df.where(F.col(fold) == k)).agg(REGRESSION[metric][1](F.col(target), F.col("y_pred")).alias("s")).first().s)
        out.append((c, float(np.mean(scores)), float(np.std(scores))))
    df.unpersist()
    return out


def expected_improvement(x: np.ndarray, y: np.ndarray, grid: np.ndarray, length: float = 0.2) -> int:
    """The grid point of the greatest expected improvement below min(y), by a Gaussian process over tried points."""
    from math import erf

    kernel = lambda a, b: np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(2) / (2 * length**2))
    mean, scale = y.mean(), y.std() or 1.0
    k = kernel(x, x) + 1e-6 * np.eye(len(x))
    cross = kernel(grid, x)
    mu = cross @ np.linalg.solve(k, (y - mean) / scale)
    var = np.maximum(1 - np.einsum("ij,ji->i", cross, np.linalg.solve(k, cross.T)), 1e-12)
    s = np.sqrt(var)
    z = (((y.min() - mean) / scale) - mu) / s
    cdf = np.array([0.5 * (1 + erf(v / 2**0.5)) for v in z])
    return int(np.argmax(s * (z * cdf + np.exp(-(z**2) / 2) / (2 * np.pi) ** 0.5)))


def bayesian(evaluate: Callable[[dict], float], space: dict[str, tuple[float, float]], n: int = 20, seed: int = 0, log: tuple[str, ...] = ()) -> list[tuple[dict, float]]:
    """(candidate, score) tried in turn, each where a Gaussian process expects the greatest improvement (least score)."""
    r = np.random.default_rng(seed)
    names = list(space)

    def candidate(u: np.ndarray) -> dict:
        return {k: float(np.exp(np.log(lo) + v * (np.log(hi) - np.log(lo))) if k in log else lo + v * (hi - lo)) for v, (k, (lo, hi)) in zip(u, space.items(), strict=True)}

    tried, out = [], []
    for i in range(n):
        grid = r.random((256, len(names)))
        u = grid[0] if i < 3 else grid[expected_improvement(np.array(tried), np.array([s for _, s in out]), grid)]
        tried.append(u)
        c = candidate(u)
        out.append((c, evaluate(c)))
    return out
