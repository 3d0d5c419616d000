"""Ensembles of regression trees grown level by level from aggregated histograms, and kept as a table.

A scan sums up weights and targets by (tree, node, feature, bin); the best cut of every node follows from
running sums over its bins, and only the cuts come to the driver. Rows are never moved or rewritten: a
scan finds each row's node by walking the trees as far as they are grown. The table of nodes is scored in the
JVM, one prediction for each tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.workers import ship

from .models import bag_uniform, poisson, with_deviation
from .sums import array_of, finite, matrix_sums

ship(__name__)

#: Bins of a feature, nodes of all trees, and histogram numbers that a task holds in one scan, at most.
BINS, NODES, HELD = 64, 2_000_000, 4_000_000


@dataclass
class Tree:
    """Nodes in heap order: node i has the children 2 i + 1 (values up to the cut) and 2 i + 2; a leaf has feature -1.

    gain: how much a cut lessens the weighted sum of squares; cover: the weight of the training rows.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    weight: float = 1.0
    largest: float = 0.0  # the largest error of training rows, if boosted

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), *(np.zeros(n) for _ in range(4)))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node in which each row of x ends."""
        at = np.zeros(len(x), dtype=int)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at


@dataclass
class Forest:
    features: list[str]
    depth: int
    trees: list[Tree] = field(default_factory=list)
    median: bool = False  # the trees' weighted median, not their mean

    def importance(self) -> dict[str, float]:
        """The mean of the trees' shares of gain by feature."""
        shares = []
        for t in self.trees:
            own = np.bincount(t.feature[t.feature >= 0], weights=t.gain[t.feature >= 0], minlength=len(self.features))
            shares.append(own / (own.sum() or 1.0))
        return dict(zip(self.features, map(float, np.mean(shares, axis=0)), strict=True))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per tree; write it to keep the forest."""
        rows = [(i, self.features, self.depth, self.median, t.weight, t.largest, t.feature.tolist(), t.cut.tolist(), t.value.tolist(), t.cover.tolist(), t.gain.tolist()) for i, t in enumerate(self.trees)]
        return spark.createDataFrame(rows, "tree int, features array<string>, depth int, median boolean, weight double, largest double, feature array<int>, cut array<double>, value array<double>, cover array<double>, gain array<double>")

    @staticmethod
    def from_table(table: DataFrame) -> Forest:
        rows = sorted(table.collect(), key=lambda r: r.tree)  # NODES bounds it
        trees = [Tree(np.array(r.feature), np.array(r.cut), np.array(r.value), np.array(r.cover), np.array(r.gain), r.weight, r.largest) for r in rows]
        return Forest(list(rows[0].features), rows[0].depth, trees, rows[0].median)


# ---------------------------------------------------------------- growing
def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending upper edges of each feature's bins: all its values if there are few, else approximate quantiles."""
    return _bin_edges(df, features, [F.lit(True)], bins)[0]


def _bin_edges(df: DataFrame, features: list[str], parts: list[Column], bins: int) -> list[list[np.ndarray]]:
    """The edges of each part of df, those rows for which a condition holds; two scans for all of them."""
    complete = finite(df, features)
    values = [[F.when(part, F.col(c).cast("double")) for c in features] for part in parts]
    few = complete.agg(*[F.approx_count_distinct(v, 0.02).alias(f"n{k}_{i}") for k, own in enumerate(values) for i, v in enumerate(own)]).first()
    edges = lambda v, n: F.collect_set(v) if n <= bins else F.array_append(F.percentile_approx(v, [k / bins for k in range(1, bins)], 100 * bins), F.max(v))
    row = complete.agg(*[edges(v, few[f"n{k}_{i}"]).alias(f"e{k}_{i}") for k, own in enumerate(values) for i, v in enumerate(own)]).first()
    return [[np.unique(row[f"e{k}_{i}"] or [0.0]) for i in range(len(features))] for k in range(len(parts))]


def _chosen(seed: int, tree: int, node: int, n: int, most: int) -> np.ndarray:
    """The features that a node may be cut by."""
    return np.arange(n) if most >= n else np.sort(np.random.default_rng([seed, tree, node]).permutation(n)[:most])


def _histograms(rows: DataFrame, trees: dict[int, Tree], level: int, forests: dict[int, list[np.ndarray]], weigh: Callable, most: int, seed: int, per: int) -> DataFrame:
    """Rows (tree, node, feature, bin, w, s): sums of weights and weighted targets in the nodes of a level.

    forests: the edges of each forest, which has `per` trees that follow one another.
    """
    n_features, n_bins, first, count = len(next(iter(forests.values()))), max(len(e) for edges in forests.values() for e in edges), 2**level - 1, 2**level

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = {t: np.zeros((count, n_features, n_bins)) for t in trees}
        s = {t: np.zeros((count, n_features, n_bins)) for t in trees}
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(dtype=float)
            places = {k: np.stack([np.minimum(np.searchsorted(e, x[:, f]), len(e) - 1) for f, e in enumerate(edges)], axis=1) for k, edges in forests.items()}
            for t, tree in trees.items():
                place = places[t // per]
                weight, node = weigh(pdf, x, y, t), tree.nodes(x) - first
                here = (node >= 0) & (node < count) & (weight > 0)
                for f in range(n_features):
                    at = (node[here] * n_features + f) * n_bins + place[here, f]
                    size = count * n_features * n_bins
                    w[t] += np.bincount(at, weights=weight[here], minlength=size).reshape(w[t].shape)
                    s[t] += np.bincount(at, weights=weight[here] * y[here], minlength=size).reshape(s[t].shape)
        for t in trees:
            mask = np.zeros((count, n_features, 1), dtype=bool)
            for node in range(count):
                mask[node, _chosen(seed, t % per, first + node, n_features, most)] = True
            node, f, b = np.nonzero((w[t] > 0) & mask)
            yield pd.DataFrame({"tree": t, "node": node + first, "feature": f, "bin": b, "w": w[t][node, f, b], "s": s[t][node, f, b]})

    return rows.mapInPandas(work, "tree int, node int, feature int, bin int, w double, s double").groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))


def _cuts(histograms: DataFrame, edges: list[np.ndarray], least: float, random_cut: int | None) -> DataFrame:
    """Rows (tree, node, w, s, best): each node's weight and sum, and its cut with the greatest gain, if any.

    Ties go to the first feature, then to the least cut. With random_cut, every feature of a node offers one
    cut only, at random between its least and greatest value there.
    """
    node = Window.partitionBy("tree", "node", "feature")
    upto = node.orderBy("bin")
    sums = histograms.select("*", F.sum("w").over(upto).alias("wl"), F.sum("s").over(upto).alias("sl"), F.sum("w").over(node).alias("wt"), F.sum("s").over(node).alias("st"), *([F.min("bin").over(node).alias("lo"), F.max("bin").over(node).alias("hi"), F.lead("bin").over(upto).alias("next")] if random_cut is not None else []))
    wr, sr = F.col("wt") - F.col("wl"), F.col("st") - F.col("sl")
    gain = F.col("sl") * F.col("sl") / F.col("wl") + sr * sr / wr - F.col("st") * F.col("st") / F.col("wt")
    able = (F.col("wl") >= least) & (wr >= least)
    if random_cut is not None:
        table = F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in edges])
        value = lambda c: F.get(F.get(table, F.col("feature")), F.col(c))
        u = F.pmod(F.xxhash64(F.lit(random_cut), "tree", "node", "feature"), F.lit(2**32)) / 2.0**32
        at = value("lo") + u * (value("hi") - value("lo"))
        able = able & (value("bin") <= at) & (F.col("next").isNotNull()) & (value("next") > at)
    best = F.min(F.when(able & (gain > 1e-9 * F.abs(F.col("st") * F.col("st") / F.col("wt")) + 1e-12), F.struct((-gain).alias("loss"), "feature", "bin", "wl", "sl"))).alias("best")
    return sums.groupBy("tree", "node").agg(F.max("wt").alias("w"), F.max_by("st", "wt").alias("s"), best)


def _grow(rows: DataFrame, edges: list[np.ndarray], trees: dict[int, Tree], depth: int, weigh: Callable, least: float, most: int, seed: int, random_cuts: bool) -> None:
    _grow_forests(rows, [edges], trees, len(trees), depth, weigh, least, most, seed, random_cuts)


def _grow_forests(rows: DataFrame, forests: list[list[np.ndarray]], trees: dict[int, Tree], per: int, depth: int, weigh: Callable, least: float, most: int, seed: int, random_cuts: bool) -> None:
    """Grow forests of `per` trees, which follow one another, in the same scans; forests: the edges of each. Random cuts are for one forest only."""
    for level in range(depth + 1):
        held = 2**level * len(forests[0]) * max(len(e) for edges in forests for e in edges) * 2
        step = max(1, HELD // held)
        for at in range(0, len(trees), step):
            part = dict(list(trees.items())[at : at + step])
            own = {k: forests[k] for k in sorted({t // per for t in part})}
            found = _cuts(_histograms(rows, part, level, own, weigh, most, seed, per), forests[0], least, seed if random_cuts else None)
            for r in found.collect():  # a row for each node
                t, best = trees[r.tree], r.best
                t.value[r.node], t.cover[r.node] = r.s / r.w, r.w
                if best is None or level == depth:
                    continue
                t.feature[r.node], t.cut[r.node], t.gain[r.node] = best.feature, forests[r.tree // per][best.feature][best.bin], -best.loss
                for child, w, s in ((2 * r.node + 1, best.wl, best.sl), (2 * r.node + 2, r.w - best.wl, r.s - best.sl)):
                    t.value[child], t.cover[child] = s / w, w
        if level + 1 == depth:  # the children of the last cuts have their values
            return


def _rows(df: DataFrame, row_id: str, features: list[str], target: str, *more: str) -> DataFrame:
    return finite(df, [*features, target]).select(F.col(row_id).alias("id"), array_of(features).alias("x"), F.col(target).cast("double").alias("y"), *more)


def _checked(trees: int, depth: int) -> None:
    if trees * 2 ** (depth + 1) > NODES:
        raise ValueError(f"{trees} trees of depth {depth} have more than {NODES} nodes")


def bags(row_id: str, n: int):
    """An array of how often each bag draws a row."""
    hashed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: bag_uniform(row_id, b))
    return F.transform(hashed, lambda u: poisson(u).cast("double"))


def random_forest(df: DataFrame, row_id: str, features: list[str], target: str, trees: int = 20, depth: int = 5, least: float = 1.0, most_features: int | None = None, bins: int = BINS, seed: int = 0) -> Forest:
    """Trees over bags of the rows (Poisson weights by the hash of row_id), each with the best cuts of up to most_features features a node.

    Rows that miss a feature or the target are left out. least: the weight of either side of a cut.
    """
    return random_forests(df, row_id, features, target, [F.lit(True)], trees, depth, least, most_features, bins, seed)[0]


def random_forests(df: DataFrame, row_id: str, features: list[str], target: str, parts: list[Column], trees: int = 20, depth: int = 5, least: float = 1.0, most_features: int | None = None, bins: int = BINS, seed: int = 0) -> list[Forest]:
    """A random_forest of each part of df, those rows for which a condition holds, all grown in the same scans."""
    _checked(trees * len(parts), depth)
    inside = [F.coalesce(p, F.lit(False)) for p in parts]
    flagged = df.withColumn("__parts", F.array(*[p.cast("double") for p in inside]))
    rows = _rows(flagged, row_id, features, target, "__parts").withColumn("bags", bags("id", trees))
    forests = [Forest(list(features), depth, [Tree.empty(depth) for _ in range(trees)]) for _ in parts]

    def weigh(pdf: pd.DataFrame, x: np.ndarray, y: np.ndarray, t: int) -> np.ndarray:
        if "bags" not in pdf.attrs:
            pdf.attrs["bags"], pdf.attrs["parts"] = np.stack(pdf["bags"].to_numpy()), np.stack(pdf["__parts"].to_numpy())
        return pdf.attrs["bags"][:, t % trees] * pdf.attrs["parts"][:, t // trees]

    grown = {k * trees + i: t for k, forest in enumerate(forests) for i, t in enumerate(forest.trees)}
    _grow_forests(rows, _bin_edges(df, features, inside, bins), grown, trees, depth, weigh, least, most_features or len(features), seed, False)
    return forests


def extra_trees(df: DataFrame, row_id: str, features: list[str], target: str, trees: int = 20, depth: int = 5, least: float = 1.0, most_features: int | None = None, bins: int = BINS, seed: int = 0) -> Forest:
    """Trees over all rows, whose features offer one random cut a node each."""
    _checked(trees, depth)
    forest = Forest(list(features), depth, [Tree.empty(depth) for _ in range(trees)])
    _grow(_rows(df, row_id, features, target), bin_edges(df, features, bins), dict(enumerate(forest.trees)), depth, lambda pdf, x, y, t: np.ones(len(x)), least, most_features or len(features), seed, True)
    return forest


def boosted_weights(x: np.ndarray, y: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """AdaBoost.R2's weights of rows after these trees: each multiplies by beta^(1 - error / largest error)."""
    out = np.ones(len(x))
    for t in trees:
        error = np.abs(y - t.value[t.nodes(x)]) / (t.largest or 1.0)
        out *= np.exp(-t.weight * (1 - error))
    return out


def ada_boost(df: DataFrame, row_id: str, features: list[str], target: str, trees: int = 20, depth: int = 3, least: float = 1.0, bins: int = BINS) -> Forest:
    """AdaBoost.R2 (Drucker 1997) with linear loss; rows are weighted, not drawn anew. Predictions are weighted medians.

    It ends early with a tree without errors, or before one whose mean loss is a half or more. Trees
    come one after another, each in depth + 2 scans.
    """
    _checked(trees, depth)
    rows, edges = _rows(df, row_id, features, target), bin_edges(df, features, bins)
    done: list[Tree] = []
    for _ in range(trees):
        before, tree = list(done), Tree.empty(depth)
        weigh = lambda pdf, x, y, t, before=before: boosted_weights(x, y, before)
        _grow(rows, edges, {0: tree}, depth, weigh, least * 1e-9, len(features), 0, False)

        def losses(pdf: pd.DataFrame, before=before, tree=tree) -> Iterator[tuple[str, np.ndarray]]:
            x, y = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(dtype=float)
            w, error = boosted_weights(x, y, before), np.abs(y - tree.value[tree.nodes(x)])
            yield "all", np.array([[w.sum(), (w * error).sum()]])

        tree.largest = _largest(rows, tree)
        sums = matrix_sums(rows, "string", losses)
        if not sums:
            break
        weight, loss = sums["all"][0]
        mean = loss / (weight * tree.largest) if tree.largest else 0.0
        if mean >= 0.5 and done:
            break
        mean = min(max(mean, 1e-12), 0.5 - 1e-12)
        tree.weight = float(np.log((1 - mean) / mean))
        done.append(tree)
        if not tree.largest:
            break
    return Forest(list(features), depth, done, median=True)


def _largest(rows: DataFrame, tree: Tree) -> float:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = 0.0
        for pdf in batches:
            if len(pdf):
                top = max(top, float(np.abs(pdf["y"].to_numpy(dtype=float) - tree.value[tree.nodes(np.stack(pdf["x"].to_numpy()).astype(float))]).max()))
        yield pd.DataFrame({"e": [top]})

    return rows.mapInPandas(work, "e double").agg(F.max("e")).first()[0] or 0.0


# ---------------------------------------------------------------- scoring, in the JVM
def learners(df: DataFrame, forest: Forest, name: str = "learners") -> DataFrame:
    """df with an array of the trees' predictions, in their order; null where a feature is missing."""
    table = forest.table(df.sparkSession).agg(F.array_sort(F.collect_list(F.struct("tree", "feature", "cut", "value"))).alias("__trees"))  # NODES bounds it
    x = F.when(F.array_contains(F.transform(array_of(forest.features), lambda v: F.coalesce(~F.isnan(v), F.lit(False))), False), None).otherwise(array_of(forest.features))
    step = lambda t: lambda node, _: F.when(F.get(t["feature"], node) < 0, node).otherwise(2 * node + 1 + (F.get(F.col("__x"), F.get(t["feature"], node)) > F.get(t["cut"], node)).cast("int"))
    leaf = lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(forest.depth)), F.lit(0), step(t))
    predicted = F.transform("__trees", lambda t: F.get(t["value"], leaf(t)))
    wide = df.withColumn("__x", x).join(F.broadcast(table))  # one row
    return wide.withColumn(name, F.when(F.col("__x").isNotNull(), predicted)).drop("__x", "__trees")


def predict(df: DataFrame, forest: Forest) -> DataFrame:
    """df with learners, y_pred and y_err: the trees' predictions, their mean (or weighted median) and deviation."""
    out = with_deviation(learners(df, forest))
    if not forest.median:
        return out
    weights = F.array(*[F.lit(t.weight) for t in forest.trees])
    pairs = F.array_sort(F.zip_with("learners", weights, lambda y, w: F.struct(y.alias("y"), w.alias("w"))))
    half = sum(t.weight for t in forest.trees) / 2
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("y"))
    walked = F.aggregate(pairs, start, lambda acc, p: F.struct((acc["w"] + p["w"]).alias("w"), F.when(acc["y"].isNull() & (acc["w"] + p["w"] >= half), p["y"]).otherwise(acc["y"]).alias("y")), lambda acc: acc["y"])
    return out.withColumn("y_pred", walked)


# ---------------------------------------------------------------- infinitesimal jackknife
def bag_products(train: DataFrame, row_id: str, n: int) -> tuple[np.ndarray, int]:
    """Sums over the training rows of products of their draws by two bags, bags x bags, and the count of the rows."""

    def products(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
        w = np.column_stack([np.ones(len(pdf)), np.stack(pdf["bags"].to_numpy()).astype(float)])
        yield "all", w.T @ w

    m = matrix_sums(train.select(bags(row_id, n).alias("bags")), "string", products).get("all", np.zeros((n + 1, n + 1)))
    return m[1:, 1:], int(m[0, 0])


def jackknife(df: DataFrame, products: np.ndarray, rows: int, corrected: bool = True) -> DataFrame:
    """df(learners, y_pred, ...) with variance: the infinitesimal jackknife of a bagged mean (Wager et al. 2014).

    The sum over training rows of squared covariances of draws and predictions is a quadratic form of
    the centred predictions in the bags' products, so training rows needn't meet test rows; draws needn't
    be centred, for centred predictions sum to zero over the bags. corrected: less the part that comes from
    the number of bags alone.
    """
    n = len(products)
    g = df.sparkSession.createDataFrame([([list(map(float, r)) for r in products],)], "__g array<array<double>>")
    wide = df.join(F.broadcast(g)).withColumn("__c", F.transform("learners", lambda t: t - F.col("y_pred")))  # one row of bags x bags numbers
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    form = dot(F.transform("__g", lambda r: dot(r, F.col("__c"))), F.col("__c")) / n**2
    less = rows / n**2 * dot(F.col("__c"), F.col("__c")) if corrected else F.lit(0.0)
    return wide.withColumn("variance", form - less).drop("__g", "__c")


# ---------------------------------------------------------------- Shapley values
def _paths(tree: Tree) -> Iterator[tuple[float, list[tuple[int, list[tuple[float, bool]], float]]]]:
    """For each leaf its value, and for each feature on the way to it: its cuts (cut, right), and the share of the cover that goes along."""

    def walk(node: int, way: dict[int, tuple[list, float]]):
        f = int(tree.feature[node])
        if f < 0:
            yield tree.value[node], [(k, cuts, share) for k, (cuts, share) in way.items()]
            return
        for child, right in ((2 * node + 1, False), (2 * node + 2, True)):
            cuts, share = way.get(f, ([], 1.0))
            yield from walk(child, way | {f: ([*cuts, (tree.cut[node], right)], share * tree.cover[child] / tree.cover[node])})

    yield from walk(0, {})


def tree_shapley(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Path-dependent Shapley values of the rows of x (Lundberg et al. 2018), and the tree's expectation.

    A leaf's weight is a product over the features on its way: whether the row goes along where a feature
    is known, else the share of the cover that does. Products over all subsets are collected by the
    number of known features, in polynomials whose coefficients are kept for all rows at once.
    """
    out, base = np.zeros(x.shape), 0.0
    for value, way in _paths(tree):
        n = len(way)
        base += value * np.prod([share for _, _, share in way]) if way else value
        along = [np.all([(x[:, f] > cut) == right for cut, right in cuts], axis=0).astype(float) for f, cuts, _ in way]
        for i, (f, _, share) in enumerate(way):
            poly = [np.ones(len(x))]
            for j in range(n):
                if j != i:
                    poly = [(way[j][2] * poly[k] if k < len(poly) else 0.0) + (along[j] * poly[k - 1] if k else 0.0) for k in range(len(poly) + 1)]
            total, weight = np.zeros(len(x)), 1.0 / n
            for k in range(n):  # weights k! (n - k - 1)! / n!
                total += weight * poly[k]
                weight *= (k + 1) / max(n - k - 1, 1)
            out[:, f] += value * (along[i] - share) * total
    return out, float(base)


def shapley(df: DataFrame, forest: Forest, row_id: str) -> DataFrame:
    """Rows (row_id, base, phi): what each feature adds to a row's mean prediction, in the order of the features.

    base plus the sum of phi is the prediction. Rows that miss a feature are left out.
    """
    kind = dict(df.dtypes)[row_id]
    rows = finite(df, forest.features).select(F.col(row_id).alias("id"), array_of(forest.features).alias("x"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, len(forest.features)))
            each = [tree_shapley(t, x) for t in forest.trees]
            phi = sum(p for p, _ in each) / len(each)
            yield pd.DataFrame({"id": pdf["id"], "base": sum(b for _, b in each) / len(each), "phi": list(phi)})

    return rows.mapInPandas(work, f"id {kind}, base double, phi array<double>").withColumnRenamed("id", row_id)


def shapley_importance(df: DataFrame, forest: Forest, row_id: str) -> DataFrame:
    """Rows (feature, total): sums of absolute Shapley values, by which features are selected."""
    phi = shapley(df, forest, row_id)
    each = phi.agg(*[F.sum(F.abs(F.get("phi", F.lit(i)))).alias(c) for i, c in enumerate(forest.features)])
    return each.unpivot([], forest.features, "feature", "total")
