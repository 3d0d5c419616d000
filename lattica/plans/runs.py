"""Run records: a folder per run and a one-row record of what it did."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, is_dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_folder(base: str, name: str, now: datetime | None = None) -> str:
    """base/name, or with the time behind it if that exists; the folder is created."""
    path = os.path.join(base, name)
    if os.path.exists(path):
        path = f"{path}_{(now or datetime.now(timezone.utc)).strftime('%Y_%m_%d_%H_%M_%S_%f')}"
    os.makedirs(path)
    return path


def _plain(x):
    if is_dataclass(x):
        return asdict(x)
    if hasattr(x, "item"):
        return x.item()
    if hasattr(x, "tolist"):
        return x.tolist()
    return str(x)


def save_record(folder: str, **parts) -> str:
    """Write the run's metadata (model, splitter, scaler, selector, scores...) as JSON."""
    path = os.path.join(folder, "run.json")
    with open(path, "w") as f:
        json.dump(parts, f, default=_plain, indent=1, sort_keys=True)
    return path


def load_record(folder: str) -> dict:
    with open(os.path.join(folder, "run.json")) as f:
        return json.load(f)


def flatten_splits(per_split: DataFrame, names: list[str], by: str = "split") -> DataFrame:
    """Rows (metric, values): each metric's values in the order of the splits, for export.

    per_split has one row a split.
    """
    long = per_split.unpivot([by], names, "metric", "value")
    ordered = F.array_sort(F.collect_list(F.struct(by, "value")))
    return long.groupBy("metric").agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


def error_data(predictions: DataFrame, part: str, sigma: str = "y_err", residual: str = "residual", y: str = "y_true") -> DataFrame:
    """Rows (row_id, sigma, residual, dataset_stdev) of one part of saved predictions.

    dataset_stdev is the population deviation of the part's distinct true values.
    """
    rows = predictions.where(F.col("part") == part)
    spread = rows.select(y).distinct().agg(F.stddev_pop(y).alias("dataset_stdev"))
    return rows.select("row_id", sigma, residual).join(F.broadcast(spread))  # one row
