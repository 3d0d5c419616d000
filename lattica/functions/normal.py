"""The normal distribution function as an expression, the same in every SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Abramowitz and Stegun, formula 26.2.17: fixed values.
P = 0.2316419
B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def cdf(x: Column) -> Column:
    """Phi(x), absolute error below 7.5e-8."""
    t = 1 / (1 + P * F.abs(x))
    series = F.lit(0.0)
    for b in reversed(B):
        series = (series + b) * t
    tail = F.exp(-x * x / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * series
    return F.when(x >= 0, 1 - tail).otherwise(tail)
