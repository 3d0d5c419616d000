"""File sources and sinks, generators, and a registry for sources that need other libraries."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REGISTERED: dict[str, Callable[..., DataFrame]] = {}


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a table by its extension. Give a schema for CSV and JSON in production: inferring reads twice.

    Pickles aren't read, since loading one can run any code.
    """
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".orc":
        return spark.read.orc(path)
    if kind in (".json", ".jsonl"):
        return spark.read.json(path, schema=schema)
    if kind in (".xlsx", ".xls"):
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise ValueError("workbooks need openpyxl; convert the file to Parquet or CSV") from e
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    raise ValueError(f"no reader for {kind or path!r}; there are csv, parquet, orc, json, jsonl and xlsx")


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Write split data, predictions or summaries, one folder for each value of `by`."""
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"no writer for {kind!r}")
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*by) if by else writer
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    """Add a source, such as a repository that is reached over the network."""
    _REGISTERED[name] = reader


def registered(name: str, *args, **options) -> DataFrame:
    if name not in _REGISTERED:
        raise KeyError(f"no source {name!r}; registered: {', '.join(sorted(_REGISTERED)) or 'none'}")
    return _REGISTERED[name](*args, **options)


def friedman(spark: SparkSession, rows: int = 100, features: int = 10, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Friedman's first regression problem: y = 10 sin(pi x0 x1) + 20 (x2 - 1/2)^2 + 10 x3 + 5 x4 + noise."""
    if features < 5:
        raise ValueError("the problem has five features at least")
    df = spark.range(rows).select(F.col("id").alias("row_id"), *[F.rand(seed + i).alias(f"x{i}") for i in range(features)], F.randn(seed + features).alias("e"))
    y = 10 * F.sin(F.lit(3.141592653589793) * F.col("x0") * F.col("x1")) + 20 * F.pow(F.col("x2") - 0.5, 2) + 10 * F.col("x3") + 5 * F.col("x4")
    return df.withColumn("y", y + noise * F.col("e")).drop("e")
