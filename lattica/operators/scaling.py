"""Scalers: fit gives one row of statistics, transform and inverse are expressions over it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _or_one(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(x)


@dataclass(frozen=True)
class Kind:
    """Statistics of a column, and the expressions of value and statistics."""

    statistics: Callable[[str], dict[str, Column]]
    forward: Callable[[Column, dict[str, Column]], Column]
    backward: Callable[[Column, dict[str, Column]], Column]


def _mean_stdev(mean: float, stdev: float) -> Kind:
    return Kind(
        lambda c: {"mean": F.avg(c), "stdev": F.stddev_samp(c)},
        lambda x, s: (x - s["mean"]) / _or_one(s["stdev"]) * stdev + mean,
        lambda x, s: (x - mean) / stdev * _or_one(s["stdev"]) + s["mean"],
    )


KINDS: dict[str, Callable[..., Kind]] = {
    "StandardScaler": lambda: Kind(lambda c: {"mean": F.avg(c), "stdev": F.stddev_pop(c)}, lambda x, s: (x - s["mean"]) / _or_one(s["stdev"]), lambda x, s: x * _or_one(s["stdev"]) + s["mean"]),
    "MinMaxScaler": lambda low=0.0, high=1.0: Kind(
        lambda c: {"lo": F.min(c).cast("double"), "hi": F.max(c).cast("double")},
        lambda x, s: (x - s["lo"]) / _or_one(s["hi"] - s["lo"]) * (high - low) + low,
        lambda x, s: (x - low) / (high - low) * _or_one(s["hi"] - s["lo"]) + s["lo"],
    ),
    "MaxAbsScaler": lambda: Kind(lambda c: {"top": F.max(F.abs(F.col(c))).cast("double")}, lambda x, s: x / _or_one(s["top"]), lambda x, s: x * _or_one(s["top"])),
    "RobustScaler": lambda low=0.25, high=0.75: Kind(
        lambda c: {"mid": F.median(c), "lo": F.percentile(c, low), "hi": F.percentile(c, high)},
        lambda x, s: (x - s["mid"]) / _or_one(s["hi"] - s["lo"]),
        lambda x, s: x * _or_one(s["hi"] - s["lo"]) + s["mid"],
    ),
    "MeanStdevScaler": lambda mean=0.0, stdev=1.0: _mean_stdev(mean, stdev),
    "NoPreprocessor": lambda: Kind(lambda c: {}, lambda x, s: x, lambda x, s: x),
}


class Scaler:
    """A scaler by name. Statistics are kept as a one-row frame and joined by broadcast."""

    def __init__(self, name: str = "StandardScaler", **options):
        if name not in KINDS:
            raise ValueError(f"no scaler {name!r}; there are {', '.join(KINDS)}")
        self.name, self.options, self.kind = name, options, KINDS[name](**options)
        self.columns: list[str] = []
        self.statistics: DataFrame | None = None

    def fit(self, df: DataFrame, columns: list[str]) -> Scaler:
        self.columns = columns
        every = [x.alias(f"__{k}__{c}") for c in columns for k, x in self.kind.statistics(c).items()]
        self.statistics = df.agg(*every) if every else None
        return self

    def _apply(self, df: DataFrame, how: Callable) -> DataFrame:
        if not self.columns:
            raise ValueError("fit the scaler first")
        wide = df.join(F.broadcast(self.statistics)) if self.statistics is not None else df  # one row
        names = {c: {k: F.col(f"__{k}__{c}") for k in self.kind.statistics(c)} for c in self.columns}
        return wide.select(*[how(F.col(c), names[c]).alias(c) if c in names else F.col(c) for c in df.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, self.kind.forward)

    def inverse(self, df: DataFrame) -> DataFrame:
        return self._apply(df, self.kind.backward)

    def fit_transform(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return self.fit(df, columns).transform(df)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write name, options, columns and statistics as one row."""
        about = json.dumps({"name": self.name, "options": self.options, "columns": self.columns})
        one = self.statistics if self.statistics is not None else spark.range(1).select()
        one.withColumn("__scaler", F.lit(about)).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        row = spark.read.parquet(path)
        about = json.loads(row.first()["__scaler"])
        out = cls(about["name"], **about["options"])
        out.columns = about["columns"]
        out.statistics = row.drop("__scaler") if len(row.columns) > 1 else None
        return out


def normalize(df: DataFrame, columns: list[str], norm: str = "l2") -> DataFrame:
    """Divide every row by its norm; rows of zeros stay."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    size = {
        "l1": F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x)),
        "l2": F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)),
        "max": F.array_max(F.transform(values, lambda x: F.abs(x))),
    }[norm]
    return df.withColumn("__norm", _or_one(size)).select(*[(F.col(c) / F.col("__norm")).alias(c) if c in columns else F.col(c) for c in df.columns])


def binarize(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    return df.withColumns({c: (F.col(c) > threshold).cast("double") for c in columns})


def bins(df: DataFrame, column: str, n: int, strategy: str = "uniform", name: str = "bin") -> DataFrame:
    """A bin from 0 to n - 1: equal widths, or edges at exact quantiles."""
    if strategy == "uniform":
        stats = df.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
        place = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * n), F.lit(n - 1))).otherwise(F.lit(0))
    elif strategy == "quantile":
        stats = df.agg(F.percentile(column, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("__edges"))
        place = F.size(F.filter("__edges", lambda e: e <= F.col(column)))
    else:
        raise ValueError(f"no strategy {strategy!r}; there are uniform and quantile")
    return df.join(F.broadcast(stats)).select(*df.columns, place.cast("int").alias(name))  # one row


def quantile_transform(df: DataFrame, column: str, n: int = 100, name: str | None = None) -> DataFrame:
    """The share of the column's distribution below each value, linear between n + 1 quantiles."""
    edges = df.agg(F.percentile(column, F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("__e"))
    at = F.greatest(F.size(F.filter("__e", lambda e: e <= F.col(column))) - 1, F.lit(0))
    low, high = F.get("__e", at), F.get("__e", at + 1)
    inside = (at + (F.col(column) - low) / _or_one(high - low)) / n
    out = F.when(F.col(column).isNull(), F.lit(None)).when(high.isNull(), F.lit(1.0)).when(F.col(column) <= F.get("__e", F.lit(0)), F.lit(0.0)).otherwise(inside)
    return df.join(F.broadcast(edges)).select(*[c for c in df.columns if c != (name or column)], out.alias(name or column))  # one row


def power_lambda(df: DataFrame, column: str, low: float = -2.0, high: float = 2.0, passes: int = 4, points: int = 17) -> float:
    """Yeo-Johnson exponent of the greatest likelihood, by narrowing grids; one aggregation each."""
    x = F.col(column)
    bend = F.sum(F.signum(x) * F.log1p(F.abs(x)))
    for _ in range(passes):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        row = df.agg(F.count(column).alias("n"), bend.alias("b"), *[F.var_pop(yeo_johnson(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        import math

        fit = [-0.5 * row.n * math.log(max(row[f"v{i}"], 1e-300)) + (g - 1) * row.b for i, g in enumerate(grid)]
        best = max(range(points), key=fit.__getitem__)
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    return (low + high) / 2


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(F.greatest(x, F.lit(0.0))) if abs(lam) < 1e-12 else (F.pow(F.greatest(x, F.lit(0.0)) + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(F.greatest(-x, F.lit(0.0))) if abs(lam - 2) < 1e-12 else -(F.pow(F.greatest(-x, F.lit(0.0)) + 1, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)
