"""Exact nearest neighbours and kernel densities between tables of any size.

Training rows are dealt to the Voronoi cells of a bounded set of pivots. What a cell can hold for a query follows
from the triangle inequality, so a query is compared only with cells that may hold one of its neighbours: first near its
own, whose result bounds the distance, then with what is left. Cells that are close travel as one group of bounded size, so
that a query is copied once for each block of rows and not for each cell; each block keeps its own best, and the
bests are merged by query. (Lu et al. 2012, for MapReduce.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.scratch import Kept
from lattica.functions.workers import ship

ship(__name__)

#: Pivots at most: with their features, all that every task gets.
PIVOTS = 1024
#: Training rows and queries of a block at most, of up to WIDTH features; with more features blocks are smaller. Smaller
#: tables are cut into SHARES, but not into blocks of fewer than LEAST rows.
BLOCK, QUERIES, WIDTH, SHARES, LEAST = 32768, 32768, 64, 8, 4096
#: Queries that are placed or compared at a time, training rows that are, and pairs that are measured anew.
CHUNK, TILE, PAIRS = 256, 2048, 16384
#: A kernel further away than so many bandwidths adds less than 1e-17 of its height.
REACH = 9.0
#: Room for the rounding of distances that come from products.
_SLACK = 1e-6


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", p: float = 3.0) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    if metric == "euclidean":
        out = 2 * a @ b.T
        np.subtract((a * a).sum(1)[:, None] + (b * b).sum(1), out, out=out)
        return np.sqrt(np.maximum(out, 0, out=out), out=out)
    if metric in ("cosine", "correlation"):
        if metric == "correlation":
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        scale = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
        return 1 - a @ b.T / np.where(scale == 0, 1, scale)
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):  # a feature at a time, so that memory doesn't grow with them
        gap = np.abs(x[:, None] - y)
        if metric == "chebyshev":
            np.maximum(out, gap, out=out)
        elif metric in ("cityblock", "minkowski"):
            out += gap if metric == "cityblock" else gap**p
        else:
            raise ValueError(f"no metric {metric!r}")
    return out ** (1 / p) if metric == "minkowski" else out


def paired(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", p: float = 3.0) -> np.ndarray:
    """Distances of each row of a to the same row of b, from differences."""
    if metric in ("cosine", "correlation"):
        if metric == "correlation":
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        scale = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return 1 - (a * b).sum(1) / np.where(scale == 0, 1, scale)
    gap = np.abs(a - b)
    if metric == "euclidean":
        return np.sqrt((gap * gap).sum(1))
    return gap.sum(1) if metric == "cityblock" else gap.max(1) if metric == "chebyshev" else (gap**p).sum(1) ** (1 / p)


class Cells:
    """Pivots, and what lies in their cells: all that is needed to rule cells out.

    Angles obey the triangle inequality where cosine and correlation distances don't, so bounds are
    taken on directions; rows without a direction are in cell -1, which is never ruled out.
    """

    def __init__(self, pivots: np.ndarray, metric: str, p: float, alone: bool = False):
        self.metric, self.p, self.alone = metric, p, alone
        self.pivots = self.placed(pivots)[0]
        self.count = np.zeros(len(pivots), dtype=np.int64)
        self.radius = np.zeros(len(pivots))
        self.loose = 0

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the space of the bounds, and whether they have a place in it."""
        if self.metric not in ("cosine", "correlation"):
            return x, np.ones(len(x), dtype=bool)
        x = x - x.mean(1, keepdims=True) if self.metric == "correlation" else x
        norm = np.linalg.norm(x, axis=1)
        return x / np.where(norm == 0, 1, norm)[:, None], norm > 0

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        return distances(x, self.pivots, "euclidean" if self.metric in ("cosine", "correlation") else self.metric, self.p)

    def in_space(self, d: np.ndarray) -> np.ndarray:
        """Distances as the metric gives them, in the space of the bounds."""
        return np.sqrt(np.maximum(2 * d, 0)) if self.metric in ("cosine", "correlation") else d

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its distance from the pivot, measured for CHUNK rows at a time."""
        at, there = self.placed(x)
        cell, far = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for c in range(0, len(x), CHUNK):
            d = self.to_pivots(at[c : c + CHUNK])
            cell[c : c + CHUNK], far[c : c + CHUNK] = d.argmin(1), d.min(1)
        return np.where(there, cell, -1), np.where(there, far, 0.0)

    def open(self, x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether the cells (columns; the last is cell -1) may hold a row within reach of each row of x."""
        at, there = self.placed(x)
        d = self.to_pivots(at)
        near = (d - self.radius <= reach[:, None] * (1 + _SLACK) + _SLACK * (1 + d)) & (self.count > 0)
        near |= ~there[:, None] & (self.count > 0)
        return np.column_stack([near, np.full(len(x), self.loose > 0)])

    def reach(self, x: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each row of x has k training rows, from the cells' counts alone; infinite if there are fewer."""
        at, there = self.placed(x)
        far = self.to_pivots(at) + self.radius
        far[:, self.count == 0] = np.inf
        order = np.argsort(far, axis=1)
        upto = np.cumsum(self.count[order], axis=1)
        first = (upto >= k).argmax(1)
        out = np.take_along_axis(far, np.take_along_axis(order, first[:, None], 1), 1)[:, 0]
        return np.where((upto[:, -1] >= k) & there, out, np.inf)

    def only(self, cells: np.ndarray) -> Cells:
        """Some of the cells, in this order; cell -1 is left as it is."""
        out = Cells.__new__(Cells)
        out.metric, out.p, out.alone, out.loose = self.metric, self.p, self.alone, self.loose
        out.pivots, out.count, out.radius = self.pivots[cells], self.count[cells], self.radius[cells]
        return out

    def most(self, rows: int) -> int:
        """Rows of a block, of `rows` at most."""
        return max(1, min(rows * WIDTH // max(self.pivots.shape[1], WIDTH), LEAST if self.alone else rows))

    def grouped(self) -> np.ndarray:
        """The group of each cell, of cell -1 last. A group's cells follow one another on a path of short steps and have a block's rows together, or it is one cell; so is every group if cells stay alone."""
        if self.alone:
            return np.arange(len(self.count) + 1)
        size = min(self.most(BLOCK), max(LEAST, -(-int(self.count.sum()) // SHARES)))
        d = self.to_pivots(self.pivots)
        group, at, here, held = np.zeros(len(self.count) + 1, dtype=np.int64), 0, 0, 0
        for _ in range(len(self.count)):
            d[:, at] = np.inf
            if held and held + self.count[at] > size:
                here, held = here + 1, 0
            group[at], held = here, held + self.count[at]
            at = int(d[at].argmin())
        group[-1] = here + 1
        return group

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (cell, grp, n) of the cells that have training rows, n counting their group's: PIVOTS and one at most."""
        group = self.grouped()
        n = np.bincount(group, np.append(self.count, self.loose)).astype(np.int64)
        rows = [(int(i), int(group[i]), int(n[group[i]])) for i, c in enumerate(self.count) if c] + ([(-1, int(group[-1]), int(self.loose))] if self.loose else [])
        return spark.createDataFrame(rows, "cell int, grp bigint, n bigint")


def _frame(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))


def packed(df: DataFrame, row_id: str, features: list[str], *more: str) -> DataFrame:
    """Rows (id, x, more): features as one array; rows that miss one are left out."""
    complete = " and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in features)
    values = df.select(F.col(row_id).alias("id"), *[F.col(c).cast("double").alias(c) for c in features], *[F.col(c).alias(f"__{i}") for i, c in enumerate(more)])
    return values.where(complete).select("id", F.array(*features).alias("x"), *[F.col(f"__{i}").alias(c) for i, c in enumerate(more)])


def build(train: DataFrame, metric: str = "euclidean", p: float = 3.0, alone: bool = False) -> tuple[Cells, DataFrame]:
    """Cells of training rows (id, x, ...), and the rows with their cell. alone: cells don't travel in groups.

    The square root of the count of the rows, up to PIVOTS, are pivots: those with the least hashes.
    Pivots and a count and a radius for each come to the driver, whatever the number of rows.
    """
    n = train.count()
    chosen = train.select("x").orderBy(F.xxhash64("id", "x"), "x").limit(int(min(PIVOTS, max(1, n**0.5)))).collect()
    cells = Cells(np.array([r.x for r in chosen], dtype=float).reshape(len(chosen), -1), metric, p, alone)
    cells.pivots, there = cells.placed(cells.pivots)
    cells.pivots = np.unique(cells.pivots[there], axis=0)
    cells.count, cells.radius = np.zeros(len(cells.pivots), dtype=np.int64), np.zeros(len(cells.pivots))
    if not len(cells.pivots):  # no row has a place
        cells.pivots, cells.count, cells.radius = np.zeros((1, len(chosen[0].x) if chosen else 1)), np.zeros(1, dtype=np.int64), np.zeros(1)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in train.schema.fields)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, d = cells.own(_frame(pdf)) if len(pdf) else (np.zeros(0, dtype=int), np.zeros(0))
            yield pdf.assign(cell=cell, d=d)

    dealt = Kept(train.mapInPandas(place, f"{fields}, cell int, d double"), "cells").df
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("d")).collect():
        if r.cell < 0:
            cells.loose = r.n
        else:
            cells.count[r.cell], cells.radius[r.cell] = r.n, r.d
    return cells, dealt.drop("d")


def _routed(queries: DataFrame, cells: Cells, choose: Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray | bool]]) -> DataFrame:
    """Queries (id, x, bound, reach) by groups of cells.

    choose: gives a reach for each query, within which rows count, and a mask of the groups in question (True: all);
    of these, a query goes to those with a cell that is open within the reach.
    """
    kind, group = queries.schema["id"].dataType.simpleString(), cells.grouped()
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(group[-1] + 1))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                x = _frame(part)
                reach, asked = choose(part, x)
                row, grp = np.nonzero(np.logical_or.reduceat(cells.open(x, reach)[:, order], starts, axis=1) & asked)
                ids, at_x, bound = part["id"].to_numpy(), part["x"].to_numpy(), part["bound"].to_numpy(dtype=float)
                for i in range(0, len(row), LEAST):  # a query may be open to many groups
                    r = row[i : i + LEAST]
                    yield pd.DataFrame({"id": ids[r], "x": at_x[r], "bound": bound[r], "reach": reach[r], "grp": grp[i : i + LEAST]})

    return queries.mapInPandas(route, f"id {kind}, x array<double>, bound double, reach double, grp bigint")


def _blocks(routed: DataFrame, dealt: DataFrame, cells: Cells) -> tuple[DataFrame, DataFrame]:
    """Both sides by (grp, block, part): a group's training rows in blocks, its queries in parts, each pair of them in one place."""
    held = cells.table(routed.sparkSession)
    counts = routed.groupBy("grp").agg(F.count("*").alias("asked"))
    part = F.least(F.lit(cells.most(QUERIES)), F.greatest(F.lit(LEAST), F.ceil(F.col("asked") / SHARES)))
    sizes = held.join(counts, "grp").select("cell", "grp", F.ceil(F.col("n") / cells.most(BLOCK)).alias("blocks"), F.ceil(F.col("asked") / part).alias("parts"))
    groups = sizes.select("grp", "blocks", "parts").distinct()
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    spread = lambda c: F.pmod(F.xxhash64("id", "x"), F.col(c))
    # as many rows as cells at most, PIVOTS and one
    a = routed.join(F.broadcast(groups), "grp").select("id", "x", "bound", "reach", "grp", upto("blocks").alias("block"), spread("parts").alias("part"))
    b = dealt.join(F.broadcast(sizes), "cell").select(*dealt.columns, "grp", spread("blocks").alias("block"), upto("parts").alias("part"))
    return a, b


def _chunks(left: pd.DataFrame, right: pd.DataFrame, cells: Cells) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Parts of the queries, those of one cell together, with their places and the numbers of the rows in cells that are open to one of them."""
    own = right["cell"].to_numpy()
    held = np.unique(own[own >= 0])
    some = cells.only(held)
    x, reach = _frame(left), left["reach"].to_numpy(dtype=float)
    nearest = np.zeros(len(x), dtype=np.int64)
    if len(held) > 1:
        for at in range(0, len(x), CHUNK):
            nearest[at : at + CHUNK] = some.to_pivots(some.placed(x[at : at + CHUNK])[0]).argmin(1)
    order = np.argsort(nearest, kind="stable")
    column = np.where(own >= 0, np.searchsorted(held, own), len(held))
    for at in range(0, len(x), CHUNK):
        i = order[at : at + CHUNK]
        seen = some.open(x[i], reach[i]).any(0)[column]
        if seen.any():
            yield left.iloc[i], x[i], np.nonzero(seen)[0]


def _search(routed: DataFrame, dealt: DataFrame, cells: Cells, k: int, skip_self: bool) -> DataFrame:
    """Rows (id, neighbour, distance, y): of every block, the k nearest within its bound of each query that it is sent."""
    kind, metric, p = routed.schema["id"].dataType.simpleString(), cells.metric, cells.p

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            every, ys, rows = right["id"].to_numpy(), right["y"].to_numpy(dtype=float), _frame(right)
            ranks = np.unique(every, return_inverse=True)[1]
            for part, a, seen in _chunks(left, right, cells):
                own, limit, size = part["id"].to_numpy(), part["bound"].to_numpy(dtype=float, copy=True), np.linalg.norm(a, axis=1)
                i, j, exact = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
                for at in range(0, len(seen), TILE):
                    tile = seen[at : at + TILE]
                    b = rows[tile]
                    d = distances(a, b, metric, p)
                    if skip_self:
                        d[own[:, None] == every[tile][None, :]] = np.inf
                    # from the second tile on, only what beats the k-th so far is looked at
                    upto = limit if at and np.isfinite(limit).all() else np.fmin(np.partition(d, min(k, len(tile)) - 1, axis=1)[:, min(k, len(tile)) - 1] if k > 1 else d.min(1), limit)
                    # all that may be among the k nearest, then their distances without the rounding of products
                    room = _SLACK * (1 + np.where(np.isfinite(upto), upto, 0) + size + np.linalg.norm(b, axis=1).max())
                    n, m = np.divmod(np.flatnonzero(d <= (upto + room)[:, None]), len(tile))
                    n, m = n[finite := np.isfinite(d[n, m])], m[finite]
                    if not len(n):
                        continue
                    measured = [np.round(paired(a[n[c : c + PAIRS]], b[m[c : c + PAIRS]], metric, p), 12) for c in range(0, len(n), PAIRS)]
                    i, j, exact = np.concatenate([i, n]), np.concatenate([j, tile[m]]), np.concatenate([exact, *measured])
                    order = np.lexsort((ranks[j], exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    last = place == k - 1
                    limit[i[last]] = np.fmin(limit[i[last]], exact[last])
                    i, j, exact = i[place < k], j[place < k], exact[place < k]
                found.append(pd.DataFrame({"id": own[i], "neighbour": every[j], "distance": exact, "y": ys[j]}))
        return pd.concat(found) if found else pd.DataFrame({"id": left["id"].iloc[:0], "neighbour": left["id"].iloc[:0], "distance": pd.Series(dtype=float), "y": pd.Series(dtype=float)})

    a, b = _blocks(routed, dealt, cells)
    keys = ["grp", "block", "part"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(best, f"id {kind}, neighbour {kind}, distance double, y double")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Rows (id, best): the k best of what the blocks found for each query, nearest first."""
    ordered = F.array_sort(F.collect_list(F.struct("distance", "neighbour", "y")))
    return found.groupBy("id").agg(F.slice(ordered, 1, k).alias("best"))


def nearest(test: DataFrame, train: DataFrame, row_id: str, features: list[str], target: str, k: int = 1, metric: str = "euclidean", skip_self: bool = False, p: float = 3.0) -> DataFrame:
    """Rows (row_id, neighbour, place, distance, y): the k nearest training rows, ties (to 12 digits) by row_id.

    Exact for tables of any size. Rows with a missing feature take no part; fewer than k training
    rows give fewer neighbours. row_id is unique in either table. metric: euclidean, cityblock,
    chebyshev, minkowski (of order p), cosine or correlation.
    """
    rows = packed(train, row_id, features, target).withColumn("y", F.col(target).cast("double")).select("id", "x", "y")
    queries = packed(test, row_id, features).withColumn("bound", F.lit(None).cast("double"))
    kind = queries.schema["id"].dataType.simpleString()
    names = ("id", "neighbour", "distance", "y")
    if rows.isEmpty():
        return queries.limit(0).select(F.col("id").alias(row_id), F.col("id").alias("neighbour"), F.lit(0).cast("bigint").alias("place"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("y"))
    cells, dealt = build(rows, metric, p)

    group = cells.grouped()

    def home(x: np.ndarray) -> np.ndarray:
        """The group of each row's own cell, as a mask; none for rows without a place."""
        out = np.zeros((len(x), group[-1] + 1), dtype=bool)
        at, there = cells.placed(x)
        d = cells.to_pivots(at)
        d[:, cells.count == 0] = np.inf
        out[np.arange(len(x)), group[d.argmin(1)]] = there & (cells.count.max() > 0)
        return out

    upto = lambda x: cells.reach(x, k + int(skip_self))
    first = Kept(_merged(_search(_routed(queries, cells, lambda part, x: (upto(x), home(x))), dealt, cells, k, skip_self), k), "first").df
    # what the own group has bounds the distance; a query that it gives no k rows is bounded by the cells' counts
    bound = first.select("id", F.when(F.size("best") >= k, F.element_at("best", -1)["distance"]).alias("bound"))
    asked = queries.drop("bound").join(bound, "id", "left")

    def rest(part: pd.DataFrame, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = cells.in_space(part["bound"].to_numpy(dtype=float) + 1e-12)
        return np.fmin(known, upto(x)), ~home(x)

    more = _search(_routed(asked, cells, rest), dealt, cells, k, skip_self)
    again = first.select("id", F.inline("best")).select("id", "neighbour", "distance", "y")
    out = _merged(again.unionByName(more.select(*names)), k).select("id", F.posexplode("best").alias("place", "b"))
    return out.select(F.col("id").cast(kind).alias(row_id), "b.neighbour", F.col("place").cast("bigint").alias("place"), "b.distance", "b.y")


def _points(rows: DataFrame) -> DataFrame:
    """Rows (id, x, weight): the distinct places of rows (x) with their numbers of rows."""
    return Kept(rows.groupBy("x").agg(F.count("*").cast("double").alias("weight")).select(F.monotonically_increasing_id().alias("id"), "x", "weight"), "points").df


def density(test: DataFrame, train: DataFrame, row_id: str, features: list[str], bandwidth: float = 1.0) -> DataFrame:
    """Rows (row_id, density): the mean of Gaussian kernels of the training rows at each test row.

    Rows in one place are one point with a weight, so the work is that of the pairs of distinct points. Cells
    beyond REACH bandwidths are left out, which changes the mean by less than 1e-17. Rows with a
    missing feature take no part; without training rows the density is null.
    """
    queries, rows = packed(test, row_id, features), packed(train, row_id, features)
    if rows.isEmpty():
        return queries.select(F.col("id").alias(row_id), F.lit(None).cast("double").alias("density"))
    points = _points(rows)
    asked, n = _points(queries), points.agg(F.sum("weight")).first()[0]
    summed = kernel_sums(asked, points.select("id", "x", F.array("weight").alias("weights")), 1, bandwidth)
    found = asked.join(summed, "id", "left").select("x", (F.coalesce(F.get("sums", F.lit(0)), F.lit(0.0)) / n).alias("density"))
    return queries.select("id", "x").join(found, "x").select(F.col("id").alias(row_id), "density")


def kernel_sums(asked: DataFrame, points: DataFrame, n: int, bandwidth: float = 1.0) -> DataFrame:
    """Rows (id, sums): for each of n weights, the weighted sum of Gaussian kernels of points (id, x, weights) at each row (id, x) of asked.

    Kernels are measured once for all weights. Rows without a point near them may be missing; their sums are 0.
    """
    cells, dealt = build(points)
    scale = 1 / (2 * bandwidth**2)
    names = [f"part{i}" for i in range(n)]

    def kernels(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, sums = [left["id"].to_numpy()[:0]], [np.zeros((0, n))]
        if len(left) and len(right):
            rows, weight = _frame(right), np.stack(right["weights"].to_numpy()).astype(float)
            for part, a, seen in _chunks(left, right, cells):
                b, w = (rows, weight) if len(seen) == len(rows) else (rows[seen], weight[seen])
                own, out = (a * a).sum(1)[:, None], np.zeros((len(a), n))
                for at in range(0, len(b), TILE):
                    tile = b[at : at + TILE]
                    d = a @ tile.T
                    d *= -2
                    d += own
                    d += (tile * tile).sum(1)
                    np.maximum(d, 0, out=d)
                    d *= -scale
                    np.exp(d, out=d)
                    out += d @ w[at : at + TILE]
                ids.append(part["id"].to_numpy())
                sums.append(out)
        return pd.DataFrame(np.concatenate(sums), columns=names).assign(id=np.concatenate(ids))[["id", *names]]

    near = lambda part, x: (np.full(len(x), REACH * bandwidth), True)
    routed = _routed(asked.select("id", "x", F.lit(None).cast("double").alias("bound")), cells, near)
    a, b = _blocks(routed, dealt, cells)
    keys = ["grp", "block", "part"]
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(kernels, "id bigint, " + ", ".join(f"{c} double" for c in names))
    return found.groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).select("id", F.array(*names).alias("sums"))
