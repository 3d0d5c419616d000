"""Prediction with fitted parameters: one projection, for tables and streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.models import linear_expression


def predict(df: DataFrame, beta: dict[str, float], calibration: tuple[float, float] | None = None, featurize: Callable[[DataFrame], DataFrame] | None = None, sigma: str | None = None, spans: dict[str, tuple[float, float]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep columns, y_pred, y_err (a * sigma + b, if calibrated) and domain (features within training's spans).

    Without aggregates or joins, so it also holds for a streaming frame.
    """
    df = featurize(df) if featurize else df
    out = [*(keep or []), linear_expression(beta).alias("y_pred")]
    if sigma:
        a, b = calibration or (1.0, 0.0)
        out.append((F.lit(a) * F.col(sigma) + F.lit(b)).alias("y_err"))
    if spans:
        inside = [F.col(c).between(F.lit(lo), F.lit(hi)).cast("int") for c, (lo, hi) in spans.items()]
        out.append(sum(inside[1:], inside[0]).alias("n_inside"))
    return df.select(*out)


def known_first(df: DataFrame, train: DataFrame, row_id: str, features: list[str], target: str, digits: int = 6) -> DataFrame:
    """df whose y_pred gives way to the true value of a training row that is equal after rounding (the least row_id's)."""
    key = lambda p: [F.round(F.col(c), digits).alias(f"{p}{c}") for c in features]
    known = train.select(*key("__"), row_id, target).groupBy(*[f"__{c}" for c in features]).agg(F.min_by(target, row_id).alias("__y"))
    keyed = df.select("*", *key("__k_"))
    same = [F.col(f"__k_{c}").eqNullSafe(F.col(f"__{c}")) for c in features]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return keyed.join(known, on, "left").withColumn("y_pred", F.coalesce("__y", "y_pred")).select(*df.columns)
