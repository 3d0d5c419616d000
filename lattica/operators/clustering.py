"""Clusters by density and by single links, exact and for tables of any size.

Both use the cells of the neighbour join: points meet only in cells that may hold something near enough. Dense
places never emit their pairs: within a block, points that are linked are joined up first, and a spanning set of
links goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.graph import components
from lattica.functions.scratch import Kept
from lattica.functions.workers import ship

from .neighbours import _SLACK, Cells, _blocks, _frame, _routed, build, distances, packed, paired

ship(__name__)

_KEYS = ["grp", "block", "part"]


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of a and b are within eps; what lies about there is measured without the rounding of products."""
    d = distances(a, b)
    out = d <= eps
    i, j = np.nonzero(np.abs(d - eps) <= _SLACK * (1 + eps + np.linalg.norm(a, axis=1).max(initial=0) + np.linalg.norm(b, axis=1).max(initial=0)))
    out[i, j] = np.round(paired(a[i], b[j]), 12) <= eps
    return out


def _meet(points: DataFrame, others: DataFrame, cells: Cells, eps: float, work, schema: str) -> DataFrame:
    """What `work` makes of blocks of points (id, x, ...) and of others (id, x, cell, ...) that may be within eps."""
    asked = points.withColumn("bound", F.lit(None).cast("double"))
    a, b = _blocks(_routed(asked, cells, lambda part, x: (np.full(len(x), eps), True)), others, cells)
    return a.groupBy(*_KEYS).cogroup(b.groupBy(*_KEYS)).applyInPandas(work, schema)


def _union(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes is linked with, from links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all() and (root[i] == root[j]).all():
            break
    return root


def linked(points: DataFrame, dealt: DataFrame, cells: Cells, eps: float) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of points within eps.

    Of a block's links, a star around the least member of each group that they join up goes on: no more than its points.
    """
    kind = points.schema["id"].dataType.simpleString()

    def stars(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"u": left["id"].iloc[:0], "v": left["id"].iloc[:0]})
        ids, back = np.unique(np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()]), return_inverse=True)
        x, y, at = _frame(left), _frame(right), 0
        i, j = [], []
        for at in range(0, len(x), 512):
            p, q = np.nonzero(_near(x[at : at + 512], y, eps))
            root = _union(len(ids), back[: len(left)][p + at], back[len(left) :][q])
            moved = np.flatnonzero(root != np.arange(len(ids)))
            i.append(moved)
            j.append(root[moved])
        root = _union(len(ids), np.concatenate(i), np.concatenate(j))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"u": ids[moved], "v": ids[root[moved]]})

    return _meet(points, dealt, cells, eps, stars, f"u {kind}, v {kind}")


def dbscan(df: DataFrame, row_id: str, features: list[str], eps: float, least: int = 5) -> DataFrame:
    """Rows (row_id, cluster, core): clusters by density (Ester et al. 1996), named by the least row_id of their core points.

    A core point has `least` points within eps, itself among them; core points within eps of each other
    share a cluster. Another point within eps of a core point belongs to the nearest one's cluster (of several at one
    distance, that with the least row_id); the rest are noise, with a null cluster. Rows that miss a feature
    are left out; row_id is unique.
    """
    points = packed(df, row_id, features)
    kind = points.schema["id"].dataType.simpleString()
    if points.isEmpty():
        return points.select(F.col("id").alias(row_id), F.col("id").alias("cluster"), F.lit(False).alias("core"))
    cells, dealt = build(points, alone=True)

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, y = _frame(left), _frame(right)
        n = [_near(x[at : at + 512], y, eps).sum(1) for at in range(0, len(x), 512)] if len(y) else []
        return pd.DataFrame({"id": left["id"] if n else left["id"].iloc[:0], "n": np.concatenate(n) if n else np.zeros(0, dtype=int)})

    counts = _meet(points, dealt, cells, eps, count, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))
    cores = Kept(counts.where(F.col("n") >= least).select("id"), "cores")
    core = points.join(cores.df, "id", "left_semi")
    core_dealt = dealt.join(cores.df, "id", "left_semi")
    roots = Kept(components(linked(core, core_dealt, cells, eps)), "clusters")
    named = cores.df.join(roots.df.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, y, found = _frame(left), _frame(right), []
        order = np.argsort(right["id"].to_numpy(), kind="stable")
        y, ids = y[order], right["id"].to_numpy()[order]
        for at in range(0, len(x) if len(y) else 0, 512):
            i, j = np.nonzero(_near(x[at : at + 512], y, eps))
            d = np.round(paired(x[at + i], y[j]), 12)
            first = np.lexsort((j, d, i))
            i, j, d = i[first], j[first], d[first]
            one = np.unique(i, return_index=True)[1]
            found.append(pd.DataFrame({"id": left["id"].to_numpy()[at + i[one]], "d": d[one], "near": ids[j[one]]}))
        return pd.concat(found) if found else pd.DataFrame({"id": left["id"].iloc[:0], "d": pd.Series(dtype=float), "near": left["id"].iloc[:0]})

    others = points.join(cores.df, "id", "left_anti")
    border = _meet(others, core_dealt, cells, eps, nearest, f"id {kind}, d double, near {kind}").groupBy("id").agg(F.min(F.struct("d", "near")).alias("b")).select("id", F.col("b.near").alias("near"))
    border = border.join(named.withColumnRenamed("id", "near"), "near").select("id", "cluster")
    every = named.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    return points.select("id").join(every, "id", "left").select(F.col("id").alias(row_id), "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def spanning_forest(df: DataFrame, row_id: str, features: list[str]) -> DataFrame:
    """Edges (u, v, distance), u < v, of the least spanning tree of all rows; ties by (u, v).

    Boruvka's rounds: each component finds the shortest edge that leaves it. A first search in each point's own
    cell bounds its component, and only cells within that bound are searched then. Components at least
    halve in number in each round, and each round is written to the shared folder.
    """
    points = packed(df, row_id, features)
    kind = points.schema["id"].dataType.simpleString()
    empty = df.sparkSession.createDataFrame([], f"u {kind}, v {kind}, distance double")
    if points.isEmpty():
        return empty
    cells, dealt = build(points, alone=True)
    # copies of a point are linked with the least one at once
    same = points.groupBy("x").agg(F.min("id").alias("least"))
    copies = points.join(same, "x").where("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("distance"))
    tree = [Kept(copies, "tree")]
    groups = Kept(points.join(same, "x").select("id", F.col("least").alias("g")), "groups")

    def shortest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        a, g = left["id"].to_numpy(), left["g"].to_numpy()
        b, h = right["id"].to_numpy(), right["g"].to_numpy()
        x, y = _frame(left), _frame(right)
        bound = left["bound"].to_numpy(dtype=float)
        for at in range(0, len(x) if len(y) else 0, 512):
            own = slice(at, at + 512)
            d = distances(x[own], y)
            d[g[own][:, None] == h[None, :]] = np.inf
            limit = np.fmin(d.min(1), bound[own])
            room = _SLACK * (1 + np.where(np.isfinite(limit), limit, 0) + np.linalg.norm(x[own], axis=1) + np.linalg.norm(y, axis=1).max())
            i, j = np.nonzero((d <= (limit + room)[:, None]) & np.isfinite(d))
            u, v = a[own][i], b[j]
            part = pd.DataFrame({"g": g[own][i], "d": np.round(paired(x[own][i], y[j]), 12), "u": np.where(u < v, u, v), "v": np.where(u < v, v, u)})
            found.append(part.sort_values(["g", "d", "u", "v"]).drop_duplicates("g"))
        return pd.concat(found).sort_values(["g", "d", "u", "v"]).drop_duplicates("g") if found else pd.DataFrame({"g": left["g"].iloc[:0], "d": pd.Series(dtype=float), "u": left["id"].iloc[:0], "v": left["id"].iloc[:0]})

    def search(routed: DataFrame, grouped: DataFrame) -> DataFrame:
        member = lambda: grouped.select(F.col("id").alias("id"), F.col("g").alias("g"))
        left, right = (side.join(member(), "id") for side in _blocks(routed, dealt, cells))
        return left.groupBy(*_KEYS).cogroup(right.groupBy(*_KEYS)).applyInPandas(shortest, f"g {kind}, d double, u {kind}, v {kind}")

    best = lambda found: found.groupBy("g").agg(F.min(F.struct("d", "u", "v")).alias("e"))
    while groups.df.select("g").distinct().limit(2).count() > 1:

        def home(part: pd.DataFrame, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out = np.zeros((len(x), len(cells.count) + 1), dtype=bool)
            out[np.arange(len(x)), cells.own(x)[0]] = True
            return np.full(len(x), np.inf), out

        first = best(search(_routed(points.withColumn("bound", F.lit(None).cast("double")), cells, home), groups.df))
        bounds = Kept(groups.df.join(first, "g", "left").select("id", F.col("e.d").alias("bound")), "bounds")
        asked = points.join(bounds.df, "id")

        def rest(part: pd.DataFrame, x: np.ndarray) -> tuple[np.ndarray, bool]:
            bound = part["bound"].to_numpy(dtype=float)
            return np.where(np.isnan(bound), np.inf, bound + 1e-12), True

        chosen = Kept(best(search(_routed(asked, cells, rest), groups.df)).select("g", "e.d", "e.u", "e.v"), "chosen")
        tree.append(Kept(chosen.df.select("u", "v", F.col("d").alias("distance")).distinct(), "tree"))
        ends = chosen.df.select("u", "v").distinct().join(groups.df.select(F.col("id").alias("u"), F.col("g").alias("gu")), "u").join(groups.df.select(F.col("id").alias("v"), F.col("g").alias("gv")), "v")
        merged = components(ends.select(F.col("gu").alias("u"), F.col("gv").alias("v"))).withColumnsRenamed({"node": "g", "root": "top"})
        then = Kept(groups.df.join(merged, "g", "left").select("id", F.coalesce("top", "g").alias("g")), "groups")
        for table in (groups, bounds, chosen):
            table.drop()
        groups = then
    out = empty
    for t in tree:
        out = out.unionByName(t.df)
    return out.distinct()


def single_link(df: DataFrame, row_id: str, features: list[str], n_clusters: int | None = None, distance: float | None = None) -> DataFrame:
    """Rows (row_id, cluster): clusters by single links, named by their least row_id.

    Either n_clusters, for which the n_clusters - 1 longest edges of the spanning tree are cut (ties: the
    edges with larger ends first), or a distance up to which points are linked. Rows that miss a feature are left out.
    """
    points = packed(df, row_id, features)
    if points.isEmpty():
        return points.select(F.col("id").alias(row_id), F.col("id").alias("cluster"))
    if n_clusters is not None:
        edges = Kept(spanning_forest(df, row_id, features), "tree")
        cut = edges.df.orderBy(F.desc("distance"), F.desc("u"), F.desc("v")).limit(n_clusters - 1)
        links = edges.df.join(F.broadcast(cut.select("u", "v")), ["u", "v"], "left_anti")  # n_clusters rows
    else:
        cells, dealt = build(points, alone=True)
        links = linked(points, dealt, cells, distance)
    roots = components(links.select("u", "v"))
    return points.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias(row_id), F.coalesce("root", "id").alias("cluster"))
