"""Seeded, engine-independent hashes and ranks without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_of(*columns: str | Column, seed: int | str = 0) -> Column:
    """md5 of the seed and the columns' texts, joined by '|'; null columns are left out."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]))


def hash_number(*columns: str | Column, seed: int | str = 0) -> Column:
    """The first 32 bits of md5_of as a bigint."""
    return F.conv(F.substring(md5_of(*columns, seed=seed), 1, 8), 16, 10).cast("bigint")


def ranked(df: DataFrame, key: str, name: str = "rank", within: list[str] | None = None, digits: int = 2) -> DataFrame:
    """df with its 1-based rank by a hexadecimal key column (unique, as from md5_of), within groups.

    The key's first `digits` digits cut every group into 16**digits ranges; counts of the ranges
    give offsets and each range is numbered by itself, so no task sorts a whole table or group.
    """
    within = within or []
    cut = df.withColumn("__range", F.substring(key, 1, digits))
    counts = cut.groupBy(*within, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1) if within else Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumnsRenamed({c: f"__o_{c}" for c in within} | {"__range": "__o_range"}).drop("__n")
    same = F.col("__range") == F.col("__o_range")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    joined = cut.join(offsets, same)
    local = F.row_number().over(Window.partitionBy(*within, "__range").orderBy(key))
    return joined.withColumn(name, (local + F.col("__before")).cast("bigint")).drop("__range", "__o_range", "__before", *[f"__o_{c}" for c in within])


def running(df: DataFrame, keys: list[str | Column], sums: dict[str, Column], ranges: int = 256) -> DataFrame:
    """df with the sums over all rows before each, in the order of its keys, which must be unique; nulls come first.

    The keys of the rows with the least hashes cut the order into ranges; sums of the ranges give
    offsets and each range is summed up by itself, so no task sorts the whole table.
    """
    keyed = df.withColumn("__key", F.struct(*[(F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate(keys)]))
    sampled = keyed.select("__key").orderBy(F.xxhash64("__key"), "__key").limit(ranges - 1)
    edges = sampled.agg(F.array_sort(F.collect_list("__key")).alias("__edges"))
    cut = keyed.join(F.broadcast(edges)).withColumn("__range", F.size(F.filter("__edges", lambda e: e <= F.col("__key")))).drop("__edges")  # one row
    per = cut.groupBy("__range").agg(*[F.sum(x).alias(f"__o_{c}") for c, x in sums.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over at most `ranges` rows
    offsets = per.select("__range", *[F.coalesce(F.sum(f"__o_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums])
    inside = Window.partitionBy("__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"__l_{c}") for c, x in sums.items()])
    joined = local.join(F.broadcast(offsets), "__range")
    return joined.select(*df.columns, *[(F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(c) for c in sums])


def numbered(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """df with its place from 0 in the order of its keys, which must be unique; nulls come first."""
    return running(df, keys, {name: F.lit(1).cast("bigint")})
