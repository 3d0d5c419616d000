"""Cleaning: missing values, outliers, strings, constant columns, merging, describing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.workers import ship

from .sums import matrix_sums

ship(__name__)

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in NUMERIC or kind.startswith("decimal")]


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN as null in the floating-point columns; every operator here that asks for missing values starts with it."""
    kinds = dict(df.dtypes)
    named = [c for c in (df.columns if columns is None else columns) if kinds[c] in ("double", "float")]
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in named else F.col(c) for c in df.columns])


def drop_rows_with_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=columns)


def columns_with_null(df: DataFrame) -> list[str]:
    """From one pass over the table."""
    row = nan_to_null(df).agg(F.count("*").alias("__all"), *[F.count(c).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] < row["__all"]]


def drop_columns_with_null(df: DataFrame, target: str | None = None) -> DataFrame:
    """Drop the columns that have a null, never the target."""
    gone = set(columns_with_null(df)) - {target}
    return df.select(*[c for c in df.columns if c not in gone])


def fill_statistics(df: DataFrame, columns: list[str], strategy: str, constant: float | None = None) -> DataFrame:
    """One row with each column's fill value; exact medians, the smallest of the most frequent values."""
    each = {
        "mean": F.avg,
        "median": F.median,
        "most_frequent": lambda c: F.mode(c, True),
        "constant": lambda c: F.max(F.lit(constant)),
    }
    if strategy not in each:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(each)}")
    return nan_to_null(df, columns).agg(*[each[strategy](c).alias(c) for c in columns])


def impute(df: DataFrame, columns: list[str], strategy: str = "mean", constant: float | None = None) -> DataFrame:
    """Fill nulls and NaN by a statistic of the column. A column without values becomes null."""
    df = nan_to_null(df, columns)
    fills = fill_statistics(df, columns, strategy, constant).select(*[F.col(c).alias(f"__{c}") for c in columns])
    return df.join(F.broadcast(fills)).select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns])  # one row


def outliers(df: DataFrame, row_id: str, columns: list[str], n_stdevs: float = 3.0) -> DataFrame:
    """Rows (row_id, column, value) further than n population deviations from the column's mean."""
    stats = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    wide = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in columns]).join(F.broadcast(stats))  # one row
    found = F.array(*[F.when(F.abs(F.col(c) - F.col(f"m_{c}")) > n_stdevs * F.col(f"s_{c}"), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c in columns])
    return wide.select(row_id, F.explode(F.array_compact(found)).alias("o")).select(row_id, "o.column", "o.value")


def outlier_counts(found: DataFrame, row_id: str) -> DataFrame:
    return found.groupBy(row_id).agg(F.count("*").alias("n_outliers"))


def columns_with_strings(df: DataFrame) -> list[str]:
    """String columns that hold something other than numbers."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return []
    row = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts]).first()
    return [c for c in texts if row[c]]


def to_numeric(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Coerce to numbers (null where that fails), drop rows without any, then columns with a null."""
    keep = keep or []
    names = [c for c in df.columns if c not in keep]
    coerced = df.select(*keep, *[F.col(c).try_cast("double").alias(c) for c in names]).na.drop("all", subset=names)
    gone = set(columns_with_null(coerced.select(*names)))
    return coerced.select(*keep, *[c for c in names if c not in gone])


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with one value at most: minimum and maximum agree and nulls are all or none."""
    row = df.agg(F.count("*").alias("__n"), *[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]).first()
    return [c for c in columns if row[f"lo_{c}"] == row[f"hi_{c}"] and row[f"n_{c}"] in (0, row["__n"])]


def drop_constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    gone = set(constant_columns(df, columns))
    return df.select(*[c for c in df.columns if c not in gone])


def merge_columns(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    return a.join(b, row_id, "full_outer")


def merge_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Outer join on all columns that both have."""
    return a.join(b, [c for c in a.columns if c in b.columns], "full_outer")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, stdev (sample), min, exact quartiles, max, distinct values."""
    stats = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stdev"), F.min(c).cast("double").alias("min"), F.percentile(c, 0.25).alias("q1"), F.percentile(c, 0.5).alias("median"), F.percentile(c, 0.75).alias("q3"), F.max(c).cast("double").alias("max")).alias(f"s{i}") for i, c in enumerate(columns)])
    return stats.select(F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))


def describe_text(df: DataFrame, column: str) -> DataFrame:
    """One row: count, distinct values, the most frequent value (the least of several) and its frequency."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("freq"))
    best = F.min(F.struct((-F.col("freq")).alias("minus"), F.col(column).alias("top"))).alias("b")
    return counted.agg(F.sum("freq").alias("n"), F.count("*").alias("n_distinct"), best).select(F.lit(column).alias("column"), "n", "n_distinct", "b.top", (-F.col("b.minus")).alias("freq"))


def rename_by_position(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def first_of_duplicates(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """The row with the least row_id for each value of key."""
    first = df.groupBy(key).agg(F.min(row_id).alias(row_id))
    return df.join(first, [key, row_id], "left_semi").select(*df.columns)


def median_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return impute(df, columns, "median")


def some_columns(columns: list[str], share: float, seed: int = 42) -> list[str]:
    """A seeded subset of columns in their order."""
    import random

    picked = set(random.Random(seed).sample(columns, max(1, round(share * len(columns)))))
    return [c for c in columns if c in picked]


@dataclass(frozen=True)
class PPCA:
    """Probabilistic principal components of standardized columns.

    loadings and noise are the model's; axes are the orthonormal principal axes of its space, explained the
    cumulative share of the columns' variance that rows with their gaps filled have along them.
    """

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    noise: float
    axes: np.ndarray
    explained: np.ndarray

    def standardized(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return _filled(pdf[self.columns].to_numpy(dtype=float), self.mean, self.scale, self.loadings, self.noise)

    def impute(self, df: DataFrame, row_id: str) -> DataFrame:
        """df with the columns' nulls filled; only rows that have any pass through Python."""

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = pd.DataFrame(self.standardized(pdf)[0] * self.scale + self.mean, columns=self.columns)
                out.insert(0, row_id, pdf[row_id].to_numpy())
                yield out

        kind, used = dict(df.dtypes)[row_id], self.columns
        data = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in used])
        fills = data.where(" or ".join(f"`{c}` is null" for c in used)).mapInPandas(fill, f"`{row_id}` {kind}, " + ", ".join(f"`{c}` double" for c in used))
        fills = fills.select(row_id, *[F.col(c).alias(f"__{c}") for c in used])
        return df.join(fills, row_id, "left").select(*[F.coalesce(c, f"__{c}").alias(c) if c in used else F.col(c) for c in df.columns])

    def transform(self, df: DataFrame, row_id: str) -> DataFrame:
        """Rows (row_id, components): each row's coordinates along the principal axes, its gaps filled."""

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({row_id: pdf[row_id], "components": list(self.standardized(pdf)[0] @ self.axes)})

        data = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in self.columns])
        return data.mapInPandas(project, f"`{row_id}` {dict(df.dtypes)[row_id]}, components array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.columns, self.mean.tolist(), self.scale.tolist(), self.loadings.tolist(), float(self.noise), self.axes.tolist(), self.explained.tolist())]
        spark.createDataFrame(rows, "columns array<string>, mean array<double>, scale array<double>, loadings array<array<double>>, noise double, axes array<array<double>>, explained array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PPCA:
        r = spark.read.parquet(path).first()
        return PPCA(list(r.columns), *(np.array(v) for v in (r.mean, r.scale, r.loadings)), r.noise, np.array(r.axes), np.array(r.explained))


def _filled(values: np.ndarray, mean: np.ndarray, scale: np.ndarray, c: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Standardized rows with their gaps at the projection, latent places, their covariances' sum, and what was seen."""
    y = (values - mean) / scale
    seen = ~np.isnan(y)
    y = np.where(seen, y, 0.0)
    own = np.einsum("ij,jk,jl->ikl", seen.astype(float), c, c) + noise * np.eye(c.shape[1])
    x = np.linalg.solve(own, (y @ c)[:, :, None])[:, :, 0]
    y = np.where(seen, y, x @ c.T)
    return y, x, noise * np.linalg.inv(own).sum(0), seen


def fit_ppca(df: DataFrame, columns: list[str], components: int | None = None, tolerance: float = 1e-4, rounds: int = 100, least_values: int = 1) -> PPCA | None:
    """Probabilistic principal components of rows with nulls (Roweis 1998, EM with missing values).

    Columns with fewer than `least_values` values take no part; None if no column is left. Each round is one
    aggregation of columns x components sums over the rows; only those and the loadings pass the driver.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns], *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    used = [c for c in columns if counts[c] >= max(1, least_values)]
    if not used:
        return None
    mean = np.array([counts[f"m_{c}"] for c in used])
    scale = np.array([counts[f"s_{c}"] or 1.0 for c in used])
    d = min(components or len(used), len(used))
    loadings = np.linalg.qr(np.random.default_rng(0).normal(size=(len(used), d)))[0]
    width = len(used)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in used])

    before, noise = None, 1.0
    for _ in range(rounds):

        def sums(pdf: pd.DataFrame, c=loadings, noise=noise) -> Iterator[tuple[str, np.ndarray]]:
            y, x, spread, seen = _filled(pdf[used].to_numpy(dtype=float), mean, scale, c, noise)
            last = np.zeros((1, c.shape[1] + 1))
            last[0, :2] = float((((y - x @ c.T) ** 2) * seen).sum()), int(seen.sum())
            yield "all", np.vstack([np.pad(y.T @ x, ((0, 0), (0, 1))), np.pad(x.T @ x + spread, ((0, 0), (0, 1))), last])

        got = matrix_sums(data, "string", sums)["all"]
        yx, xx, (err, n) = got[:width, :d], got[width : width + d, :d], got[-1, :2]
        loadings, noise = yx @ np.linalg.pinv(xx), max(err / max(n, 1), 1e-6)
        if before is not None and abs(before - err) <= tolerance * max(before, 1e-12):
            break
        before = err

    span = np.linalg.qr(loadings)[0]

    def spread(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
        y = _filled(pdf[used].to_numpy(dtype=float), mean, scale, loadings, noise)[0]
        wide = np.column_stack([np.ones(len(y)), y])
        yield "all", wide.T @ wide

    m = matrix_sums(data, "string", spread)["all"]
    covariance = m[1:, 1:] / m[0, 0] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0] ** 2
    values, vectors = np.linalg.eigh(span.T @ covariance @ span)
    order = np.argsort(-values)
    return PPCA(used, mean, scale, loadings, float(noise), span @ vectors[:, order], np.cumsum(values[order]) / np.trace(covariance))


def ppca(df: DataFrame, row_id: str, columns: list[str], components: int | None = None, tolerance: float = 1e-4, rounds: int = 100, least_values: int = 1) -> DataFrame:
    """df with nulls filled by probabilistic principal components; columns with too few values are left as they are."""
    model = fit_ppca(df, columns, components, tolerance, rounds, least_values)
    return df if model is None else model.impute(df, row_id)


@dataclass(frozen=True)
class Cleaned:
    """data: the cleaned rows; outliers: (row_id, column, value) before cleaning; strings: columns that hold texts."""

    data: DataFrame
    outliers: DataFrame
    strings: list[str]


def clean(df: DataFrame, row_id: str, method: str, columns: list[str], target: str | None = None, strategy: str = "mean", n_stdevs: float = 3.0, **options) -> Cleaned:
    """Flag texts and outliers, then treat missing values by `method`.

    method: drop_rows, drop_columns, impute (with a strategy) or ppca.
    """
    df = nan_to_null(df, columns)
    methods = {
        "drop_rows": lambda: drop_rows_with_null(df, columns),
        "drop_columns": lambda: df.drop(*[c for c in columns_with_null(df.select(*columns)) if c != target]),
        "impute": lambda: impute(df, columns, strategy, **options),
        "ppca": lambda: ppca(df, row_id, columns, **options),
    }
    if method not in methods:
        raise ValueError(f"no method {method!r}; there are {', '.join(methods)}")
    return Cleaned(methods[method](), outliers(df, row_id, columns, n_stdevs), columns_with_strings(df))
