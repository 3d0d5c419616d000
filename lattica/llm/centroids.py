"""Operator 13: centroids of quantised vectors by Lloyd's rounds over distinct vectors with multiplicities.

Vectors are rounded down to a grid, identical ones are grouped and counted, and the rounds run on the
distinct ones with sums of integers weighted by the counts. So copies cost one row, and every result is exact
and the same in whatever order and on whatever machines it is added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, stage

ship(__name__)

#: Components of a vector, steps of the grid in a unit, centroids, rounds.
DIMENSIONS, STEPS, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Grid coordinates stop here on either side; below it, squared distances and their terms fit in 64 bits.
EDGE = 2**27
#: A vector is common if it is one of so many or more: there are no more than this many common ones.
COMMON = 1000
#: Rows whose distances a task holds at a time.
_CHUNK = 4096


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, steps: int = STEPS) -> DataFrame:
    """Rows (vec_id, q) of the vectors (vec_id, embedding) with exactly so many components, none null, NaN or infinite.

    q: floor(steps * x) of each component as a double, an int; beyond EDGE, which no vector of use
    comes near, it is held at EDGE.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    grid = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * steps).cast("double"), F.lit(float(EDGE))), F.lit(float(-EDGE))).cast("int"))
    return vectors.where((F.size("embedding") == dimensions) & finite).select("vec_id", grid.alias("q"))


def first_centroids(kept: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The q of the k rows with the smallest lower-case hexadecimal SHA-256 of `1:<vec_id>`, in its order.

    Of rows with one vec_id, those with the smaller q come first; rows without a vec_id come last.
    Fewer rows give fewer centroids.
    """
    hashed = kept.select("q", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"))
    return np.array([r.q for r in hashed.orderBy(F.col("hash").asc_nulls_last(), "q").limit(k).collect()], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row, the one with the smaller number of several, and the squared distance."""
    numbers, distances = [], []
    for at in range(0, len(x), _CHUNK):
        part = x[at : at + _CHUNK]
        d = (part * part).sum(1)[:, None] - 2 * (part @ centroids.T) + (centroids * centroids).sum(1)
        numbers.append(d.argmin(1))
        distances.append(d.min(1))
    return np.concatenate(numbers), np.concatenate(distances)


def _read(batch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1), batch.column(1).to_numpy().astype(np.int64)


def _summing(centroids: np.ndarray):
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        totals = np.zeros((len(centroids), centroids.shape[1] + 1), dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, weight = _read(batch)
            number, _ = nearest(x, centroids)
            x = np.column_stack([x, np.ones(len(x), dtype=np.int64)])
            if int(np.abs(x).max()) * sum(map(int, weight)) >= 2**62:  # sums that 64 bits may not hold
                x, weight = x.astype(object), weight.astype(object)
            for k in np.unique(number):
                own = number == k
                totals[k] += (x[own] * weight[own, None]).sum(0).astype(object)
        rows = [(k, i, Decimal(int(totals[k, i]))) for k in range(len(totals)) if totals[k, -1] for i in range(totals.shape[1])]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.decimal128(38, 0))], names=["cluster", "place", "total"])

    return work


def _assigning(centroids: np.ndarray):
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                number, distance = nearest(_read(batch)[0], centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["q", "weight", "cluster", "distance"])

    return work


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid that has vectors becomes floor(sum / count) of their components; others stay.

    distinct: rows (q, weight). A task passes on a row for each centroid and component, and as many
    come to the driver: centroids x dimensions numbers, whatever the input's size.
    """
    sums = distinct.select("q", "weight").mapInArrow(_summing(centroids), "cluster int, place int, total decimal(38,0)").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
    total = {(r.cluster, r.place): int(r.total) for r in sums.collect()}
    out, width = centroids.copy(), centroids.shape[1]
    for k in range(len(out)):
        if n := total.get((k, width)):
            out[k] = [total[k, i] // n for i in range(width)]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, steps: int = STEPS) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each vector that is kept.

    vectors: (vec_id, embedding), other columns are ignored; repeated rows and rows without a vec_id
    count like any other. No vector that can be kept gives no rows. Inertias beyond a bigint are null.

    Vectors that are 1 in COMMON or more, so COMMON of them at most, are joined with their centroid by
    a broadcast; the others, none of which has more than a thousandth of the rows, by a shuffle.
    """
    kept = quantised(vectors, dimensions, steps)
    distinct = stage(kept.groupBy("q").agg(F.count("*").alias("weight")), "distinct")
    centroids = first_centroids(kept, k)
    if not len(centroids):
        return distinct.select(*[F.lit(None).cast(kind).alias(c) for c, kind in (("vec_id", kept.schema["vec_id"].dataType), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    assigned = stage(distinct.select("q", "weight").mapInArrow(_assigning(centroids), "q array<int>, weight bigint, cluster int, distance bigint"), "assigned")
    discard(distinct)

    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")).alias("inertia"), F.sum("weight").alias("n")).collect()
    n, inertia = sum(r.n for r in per), sum(int(r.inertia) for r in per)
    fits = lambda x: x if x < 2**63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = assigned.sparkSession.createDataFrame([(r.cluster, fits(int(r.inertia)), fits(inertia), digest(r.cluster)) for r in per], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")

    common = F.broadcast(assigned.where(F.col("weight") * COMMON >= n))
    rare = assigned.where(F.col("weight") * COMMON < n)
    columns = ("vec_id", "cluster", "distance")
    met = kept.join(common, "q").select(*columns).unionByName(kept.join(common.select("q"), "q", "left_anti").join(rare, "q").select(*columns))
    return met.join(F.broadcast(about), "cluster").select(*columns, "cluster_inertia", "inertia", "centroid_sha256")
