"""Feature selection. A selector returns the names it keeps, in order; callers select the columns."""

from __future__ import annotations

import itertools
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import _matrix, gram, solve


def variances(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows (feature, variance), population variances from one pass."""
    return df.agg(*[F.var_pop(c).alias(c) for c in features]).unpivot([], features, "feature", "variance")


def variance_threshold(df: DataFrame, features: list[str], threshold: float = 0.0) -> list[str]:
    row = df.agg(*[F.var_pop(c).alias(c) for c in features]).first()
    return [c for c in features if row[c] is not None and row[c] > threshold]


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, r) for a < b by position, from one aggregation; null where a column is constant."""
    pairs = list(itertools.combinations(columns, 2))
    n = F.count("*")

    def r(a: str, b: str):
        spread = F.stddev_pop(a) * F.stddev_pop(b)
        return F.when(spread > 0, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))

    row = df.agg(n.alias("n"), *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[f"p{i}" for i in range(len(pairs))])))


def f_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Rows (feature, f): the F statistic of a linear relation with the target."""
    each = [F.struct(F.lit(c).alias("feature"), F.corr(c, target).alias("r")).alias(c) for c in features]
    one = df.agg(F.count(target).alias("__n"), *each)
    return one.select("__n", F.inline(F.array(*features))).select("feature", (F.col("r") * F.col("r") / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)) * (F.col("__n") - 2)).alias("f"))


def k_best(df: DataFrame, features: list[str], target: str, k: int) -> list[str]:
    rows = f_scores(df, features, target).collect()
    return [r.feature for r in sorted(rows, key=lambda r: (-(r.f if r.f is not None else float("inf")), r.feature))[:k]]


def pearson(df: DataFrame, features: list[str], target: str, between: float = 0.9, with_target: float = 0.0, n: int | None = None) -> list[str]:
    """Drop the later of two features that correlate with |r| >= between, then rank by |r| with the target.

    with_target is the least |r|; with n, it is lowered by 0.05 until n features pass or it reaches 0.
    """
    found = correlations(df, [*features, target]).collect()
    r = {(x.a, x.b): x.r for x in found}
    gone: set[str] = set()
    for a, b in itertools.combinations(features, 2):
        if a not in gone and b not in gone and abs(r[a, b] or 0) >= between:
            gone.add(b)
    score = {c: abs(r[c, target] or 0) for c in features if c not in gone}
    order = sorted(score, key=lambda c: (-score[c], c))
    while n is not None and with_target > 0 and sum(score[c] >= with_target for c in order) < n:
        with_target = max(0.0, with_target - 0.05)
    kept = [c for c in order if score[c] >= with_target]
    return kept[:n] if n is not None else kept


def forward(df: DataFrame, features: list[str], target: str, fold: str, n: int, start: list[str] | None = None) -> list[tuple[str, float]]:
    """Forward selection by the cross-validated RMSE of linear models: (feature, RMSE) in order of choice.

    One Spark job takes the sums per fold; every candidate is then a small solve on the driver.
    """
    rows = gram(df, features, target, [fold]).collect()
    parts = [_matrix(r, len(features) + 2) for r in rows]
    total = sum(parts, np.zeros_like(parts[0]))

    def rmse(names: list[str]) -> float:
        pick = [0, *[features.index(c) + 1 for c in names], len(features) + 1]
        scores = []
        for m in parts:
            beta = solve((total - m)[np.ix_(pick, pick)])
            t = m[np.ix_(pick, pick)]
            v = np.concatenate([beta, [-1.0]])
            scores.append(np.sqrt(max(v @ t @ v, 0) / t[0, 0]))
        return float(np.mean(scores))

    chosen = list(start or [])
    out = [(c, rmse(chosen[: i + 1])) for i, c in enumerate(chosen)]
    while len(chosen) < min(n, len(features)):
        score, best = min((rmse([*chosen, c]), c) for c in features if c not in chosen)
        chosen.append(best)
        out.append((best, score))
    return out


def ensemble_importance(df: DataFrame, features: list[str], target: str, n: int, model: str = "RandomForestRegressor", n_random_dummy: int = 0, n_permuted_dummy: int = 0, row_id: str | None = None, seed: int = 1) -> list[tuple[str, float]]:
    """(feature, importance) of the n best features by a tree ensemble, with dummies to compare with.

    Random dummies are normal numbers with the features' mean mean and mean deviation; permuted ones
    are a feature's values under the ids of other rows.
    """
    from .models import fit

    names = list(features)
    if n_random_dummy:
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
        mean = float(np.mean([row[f"m{i}"] for i in range(len(features))]))
        scale = float(np.mean([row[f"s{i}"] for i in range(len(features))]))
        for k in range(n_random_dummy):
            df = df.withColumn(f"dummy_random_{k}", F.randn(seed + k) * scale + mean)
            names.append(f"dummy_random_{k}")
    if n_permuted_dummy:
        from .baselines import permuted

        for k, c in enumerate(features[:n_permuted_dummy]):
            df = df.join(permuted(df, row_id, c, f"dummy_permuted_{c}", seed=k), row_id)
            names.append(f"dummy_permuted_{c}")
    model = fit(df, names, target, model, seed=seed)
    got = sorted(zip(names, map(float, model.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))
    return [x for x in got if x[0] in features][:n] if not (n_random_dummy or n_permuted_dummy) else got[: n + n_random_dummy + n_permuted_dummy]


def below_dummies(ranking: list[tuple[str, float]], prefix: str = "dummy_") -> list[str]:
    """Features that rank below the best dummy, with a warning: they tell no more than noise does."""
    places = [i for i, (c, _) in enumerate(ranking) if c.startswith(prefix)]
    out = [c for c, _ in ranking[places[0] :] if not c.startswith(prefix)] if places else []
    if out:
        warnings.warn(f"ranked below a dummy: {', '.join(out)}", stacklevel=2)
    return out


def linear_shap(df: DataFrame, beta: dict[str, float], features: list[str]) -> DataFrame:
    """Rows (feature, total): sums of |b (x - mean)|, the Shapley values of a linear model."""
    mean = df.agg(*[F.avg(c).alias(f"__{c}") for c in features])
    each = df.join(F.broadcast(mean)).agg(*[F.sum(F.abs(F.lit(beta[c]) * (F.col(c) - F.col(f"__{c}")))).alias(c) for c in features])  # one row
    return each.unpivot([], features, "feature", "total")


def between_sets(df: DataFrame, left: list[str], right: list[str], least: float = 0.7) -> DataFrame:
    """Rows (left_feature, right_feature, r) with |r| > least; features of both sets have r = 1."""
    pairs = [(a, b) for a in left for b in right]
    each = [F.struct(F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"), (F.lit(1.0) if a == b else F.corr(a, b)).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    return df.agg(*each).select(F.inline(F.array(*[f"p{i}" for i in range(len(pairs))]))).where(F.abs("r") > least)
