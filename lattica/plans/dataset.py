"""Datasets with explicit roles and an explicit row identity."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.order import md5_of


@dataclass(frozen=True)
class Dataset:
    """A frame whose columns have roles. Spark has no row order, so `row_id` identifies rows."""

    df: DataFrame
    row_id: str
    features: list[str]
    target: str | None = None
    group: str | None = None
    extra: list[str] = field(default_factory=list)
    leave_out: list[str] = field(default_factory=list)

    def projected(self) -> DataFrame:
        """Only the columns that have a role, so that a scan reads no others."""
        names = [self.row_id, *self.features, self.target, self.group, *self.extra, *self.leave_out]
        return self.df.select(*dict.fromkeys(n for n in names if n))

    def left_out(self) -> DataFrame:
        """Rows (row_id, leave_out_set) of the rows whose flag column is 1."""
        sets = [self.df.where(F.col(c) == 1).select(self.row_id, F.lit(c).alias("leave_out_set")) for c in self.leave_out]
        out = self.df.select(self.row_id, F.lit("").alias("leave_out_set")).limit(0)
        for s in sets:
            out = out.unionByName(s)
        return out


def infer_roles(columns: list[str], features: list[str] | None = None, target: str | None = None, group: str | None = None, extra: list[str] | None = None, leave_out: list[str] | None = None) -> tuple[list[str], str | None]:
    """Features and target from whatever is given: the last column that no role claims is the target."""
    others = {group, *(extra or []), *(leave_out or [])}
    if features is None and target is None:
        free = [c for c in columns if c not in others]
        return free[:-1], free[-1] if free else None
    if features is None:
        return [c for c in columns if c != target and c not in others], target
    if target is None:
        free = [c for c in columns if c not in features and c not in others]
        return features, free[-1] if free else None
    return features, target


def load(df: DataFrame, row_id: str | None = None, average_by: str | None = None, **roles) -> Dataset:
    """A dataset from a frame. Without row_id, the md5 of all columns identifies a row.

    average_by: rows with equal values of this column become one, with means of the numeric columns.
    NaN becomes null, so that every aggregate skips it.
    """
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    df = df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats}) if floats else df
    if average_by:
        df = average_duplicates(df, average_by)
    columns = [c for c in df.columns if c != row_id]
    features, target = infer_roles(columns, **{k: roles.get(k) for k in ("features", "target", "group", "extra", "leave_out")})
    if row_id is None:
        row_id, df = "row_id", df.withColumn("row_id", md5_of(*df.columns))
    return replace(Dataset(df, row_id, features, target), group=roles.get("group"), extra=roles.get("extra") or [], leave_out=roles.get("leave_out") or [])


def average_duplicates(df: DataFrame, by: str) -> DataFrame:
    """Means of the numeric columns over rows with equal `by`; other columns go."""
    numeric = [c for c, kind in df.dtypes if c != by and (kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"))]
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in numeric])
