"""Sums of small matrices over large tables."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.workers import ship

ship(__name__)


def matrix_sums(df: DataFrame, key: str, parts: Callable[[pd.DataFrame], Iterable[tuple[Hashable, np.ndarray]]]) -> dict:
    """{key: matrix}: the sums of the matrices that `parts` yields with a key for each batch of rows.

    key: the keys' Spark type. All matrices have one width. A task adds its batches up and passes on one
    row for each row of a matrix; these are summed in the JVM. What a task holds and what comes to
    the driver are keys x rows x width numbers, whatever the size of the table.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for k, m in parts(pdf) if len(pdf) else ():
                held[k] = held[k] + m if k in held else m
        for k, m in held.items():
            yield pd.DataFrame({"k": [k] * len(m), "i": np.arange(len(m)), "row": list(m)})

    rows = df.mapInPandas(work, f"k {key}, i int, row array<double>")
    summed = rows.groupBy("k", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).orderBy("k", "i")
    out: dict = {}
    for r in summed.collect():
        out.setdefault(r.k, []).append(r.row)
    return {k: np.array(m) for k, m in out.items()}


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that miss none of the columns, null or NaN."""
    return df.where(" and ".join(f"`{c}` is not null and not isnan(cast(`{c}` as double))" for c in columns)) if columns else df


def array_of(columns: list[str]):
    return F.array(*[F.col(c).cast("double") for c in columns])
