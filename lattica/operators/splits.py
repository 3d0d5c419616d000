"""Splitters. A split table has rows (split, row_id, role, weight): role is train or test.

Folds by hash need no shuffle; exact sizes use distributed ranks. A row is never stored k times
where a fold number suffices: `train_test` expands fold tables only for callers that need roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.order import hash_number, md5_of, numbered, ranked
from lattica.functions.scratch import Kept

from . import neighbours


#: Combinations of groups up to which they are broadcast.
COMBINATIONS = 100_000


def hash_folds(df: DataFrame, row_id: str, k: int, seed: int = 0) -> DataFrame:
    """(row_id, fold): about equal folds by hash; a projection without a shuffle."""
    return df.select(row_id, (hash_number(row_id, seed=seed) % k).cast("int").alias("fold"))


def exact_folds(df: DataFrame, row_id: str, k: int, seed: int = 0, stratum: str | None = None) -> DataFrame:
    """(row_id, fold): folds whose sizes differ by one at most, within each stratum if given."""
    cols = [row_id, stratum] if stratum else [row_id]
    keyed = df.select(*cols, md5_of(row_id, seed=seed).alias("__key"))
    out = ranked(keyed, "__key", "__rank", [stratum] if stratum else None)
    return out.select(row_id, ((F.col("__rank") - 1) % k).cast("int").alias("fold"))


def repeated_folds(df: DataFrame, row_id: str, k: int, repeats: int) -> DataFrame:
    """(repeat, row_id, fold) by hash, each repeat with its own seed."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), (hash_number(row_id, seed=r) % k).cast("int").alias("fold")) for r in range(repeats)]))
    return df.select(row_id, each.alias("e")).select("e.repeat", row_id, "e.fold")


def train_test(folds: DataFrame, row_id: str, k: int) -> DataFrame:
    """The split table of a fold table: split i tests fold i and trains on the others."""
    role = F.when(F.col("fold") == F.col("split"), "test").otherwise("train")
    return folds.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("split"), row_id, "fold").select("split", row_id, role.alias("role"), F.lit(1).alias("weight"))


def groups_numbered(df: DataFrame, group: str) -> DataFrame:
    """(group, split): groups in their order, numbered from 0; one row per group. Null is a group, the first."""
    return numbered(df.select(group).distinct(), [group], "split")


def _with_number(df: DataFrame, row_id: str, group: str, of_groups: DataFrame, number: str) -> DataFrame:
    """(row_id, number): each row with its group's number; rows without a group meet the group null."""
    named = of_groups.select(F.col(group).alias("__group"), number)
    return df.select(row_id, group).join(named, F.col(group).eqNullSafe(F.col("__group"))).select(row_id, number)


def leave_one_group_out(df: DataFrame, row_id: str, group: str) -> DataFrame:
    """(row_id, fold): the fold is the group's number, so each group is the test set once. Null is a group."""
    return _with_number(df, row_id, group, groups_numbered(df, group), "split").select(row_id, F.col("split").cast("int").alias("fold"))


def group_folds(df: DataFrame, row_id: str, group: str, k: int) -> DataFrame:
    """(row_id, fold) with whole groups in folds; larger groups are dealt first, in turn. Null is a group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    dealt = numbered(sizes, [-F.col("n"), group], "__place").select(group, (F.col("__place") % k).cast("int").alias("fold"))
    return _with_number(df, row_id, group, dealt, "fold")


def just_each_group(df: DataFrame, row_id: str, group: str) -> DataFrame:
    """Train on one group, test on the rest; one split per group. Null is a group.

    The result has rows x groups rows; a row knows its own group's number and counts through the others.
    """
    of_groups = groups_numbered(df, group)
    count = of_groups.agg(F.count("*").alias("__groups"))
    own = _with_number(df, row_id, group, of_groups, "split").withColumnRenamed("split", "__own").join(F.broadcast(count))  # one row
    each = own.select(row_id, "__own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__groups") - 1)).alias("split"))
    role = F.when(F.col("split") == F.col("__own"), "train").otherwise("test")
    return each.select(F.col("split").cast("int").alias("split"), row_id, role.alias("role"), F.lit(1).alias("weight"))


def no_split(df: DataFrame, row_id: str) -> DataFrame:
    """Everything trains and everything is tested."""
    return df.select(F.lit(0).alias("split"), row_id, F.explode(F.array(F.lit("train"), F.lit("test"))).alias("role"), F.lit(1).alias("weight"))


def leave_out_percent(df: DataFrame, row_id: str, share: float = 0.2, repeats: int = 5) -> DataFrame:
    """Random test sets of ceil(share * n) rows."""
    keyed = df.select(row_id, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("split")).withColumn("__key", md5_of("split", row_id))
    numbered = ranked(keyed, "__key", "__rank", ["split"])
    n = df.agg(F.ceil(F.count("*") * F.lit(share)).alias("__most"))
    role = F.when(F.col("__rank") <= F.col("__most"), "test").otherwise("train")
    return numbered.join(F.broadcast(n)).select("split", row_id, role.alias("role"), F.lit(1).alias("weight"))  # one row


def time_series_folds(df: DataFrame, row_id: str, order: Column, k: int, ranges: int = 256) -> DataFrame:
    """(row_id, block): k + 1 consecutive blocks in time; split i tests block i + 1 and trains on all before.

    order: a numeric or time column that sorts rows; ties go by row_id. The column is cut into
    ranges at its approximate quantiles: counts of the ranges give offsets, and every range is numbered by
    itself. Rows of one time value share a range.
    """
    keyed = df.select(row_id, order.alias("__t"))
    at = F.col("__t").cast("double") if dict(keyed.dtypes)["__t"] not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(F.col("__t").cast("timestamp")).cast("double")
    # quantiles of the rows themselves, so that ranges hold about as many rows each
    edges = keyed.agg(F.array_sort(F.array_distinct(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], 10 * ranges))).alias("__edges"))
    cut = keyed.withColumn("__at", at).join(F.broadcast(edges)).withColumn("__range", F.size(F.filter("__edges", lambda e: e <= F.col("__at")))).drop("__edges")  # one row
    counts = cut.groupBy("__range").agg(F.count("*").alias("__n"))
    running = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over at most `ranges` rows
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__all"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy("__t", row_id))
    placed = cut.withColumn("__local", local).join(F.broadcast(offsets), "__range")  # at most `ranges` rows
    test = F.floor(F.col("__all") / (k + 1))
    first = F.col("__all") - test * k
    rank = F.col("__before") + F.col("__local")
    return placed.select(row_id, F.when(rank <= first, F.lit(0)).otherwise(F.ceil((rank - first) / test)).cast("int").alias("block"))


def predefined(df: DataFrame, row_id: str, fold: str) -> DataFrame:
    """(row_id, fold) from a column; rows with -1 only train."""
    return df.select(row_id, F.col(fold).cast("int").alias("fold"))


def leave_multi_groups_out(df: DataFrame, row_id: str, group: str, size: int = 2) -> DataFrame:
    """(split, row_id, role, weight): every combination of `size` groups is the test set once. Null is a group.

    The combinations are numbered in their order by ranges; nothing of them comes to the driver. The result has
    rows x combinations rows: every row is matched with all of them, which are broadcast up to COMBINATIONS.
    """
    of_groups = groups_numbered(df, group)
    combos = of_groups.select(F.col("split").alias("g0"))
    for i in range(1, size):
        combos = combos.join(of_groups.select(F.col("split").alias(f"g{i}")), F.col(f"g{i}") > F.col(f"g{i - 1}"))
    names = [f"g{i}" for i in range(size)]
    combos = numbered(combos, names, "split").select(F.col("split").cast("int").alias("split"), F.array(*names).alias("__test"))
    combos = F.broadcast(combos) if combos.count() <= COMBINATIONS else combos
    own = _with_number(df, row_id, group, of_groups, "split").withColumnRenamed("split", "__own")
    role = F.when(F.array_contains("__test", F.col("__own")), "test").otherwise("train")
    return own.join(combos).select("split", row_id, role.alias("role"), F.lit(1).alias("weight"))


def bootstrap(df: DataFrame, row_id: str, n_bootstraps: int = 3, train_share: float = 0.5, seed: int = 0) -> DataFrame:
    """Permute, cut into train and test, and draw from each with replacement; weight counts a row's draws.

    Draw j of a part takes the row whose rank is a hash of j modulo the part's size.
    """
    keyed = df.select(row_id, F.explode(F.sequence(F.lit(0), F.lit(n_bootstraps - 1))).alias("split")).withColumn("__key", md5_of("split", row_id, seed=seed))
    numbered = ranked(keyed, "__key", "__rank", ["split"])
    total = df.agg(F.count("*").alias("__n"))
    cut = F.ceil(F.col("__n") * F.lit(train_share))
    parts = numbered.join(F.broadcast(total)).select("split", row_id, F.when(F.col("__rank") <= cut, "train").otherwise("test").alias("role"), F.when(F.col("__rank") <= cut, F.col("__rank") - 1).otherwise(F.col("__rank") - 1 - cut).alias("place"), F.when(F.col("__rank") <= cut, cut).otherwise(F.col("__n") - cut).alias("__size"))
    drawn = parts.select("split", "role", (hash_number("split", "role", "place", seed=f"draw{seed}") % F.col("__size")).alias("place"))
    counts = drawn.groupBy("split", "role", "place").agg(F.count("*").cast("int").alias("weight"))
    return parts.join(counts, ["split", "role", "place"]).select("split", row_id, "role", "weight")


def twins(df: DataFrame, row_id: str, features: list[str], threshold: float = 0.0, order: float = 2.0) -> DataFrame:
    """(row_id) of rows with another row within a Minkowski distance.

    A threshold of 0 is an equality group. Otherwise rows are cut into cells of the threshold's
    width along the widest feature, and only neighbouring cells are compared.
    """
    if threshold <= 0:
        return df.join(df.groupBy(*features).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"), features, "left_semi").select(row_id)
    spans = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in features]).first()
    widest = max(features, key=lambda c: spans[c] or 0)
    cell = F.floor(F.col(widest) / F.lit(threshold)).cast("bigint")
    a = df.select(row_id, *features, cell.alias("__cell"))
    b = df.select(F.col(row_id).alias("__other"), *[F.col(c).alias(f"__{c}") for c in features], F.explode(F.array(cell - 1, cell, cell + 1)).alias("__cell"))
    gap = [F.pow(F.abs(F.col(c) - F.col(f"__{c}")), F.lit(order)) for c in features]
    near = sum(gap[1:], gap[0]) <= threshold**order + 1e-12
    return a.join(b, "__cell").where((F.col(row_id) != F.col("__other")) & near).select(row_id).distinct()


def auto_twins(df: DataFrame, row_id: str, features: list[str], threshold: float = 0.0, order: float = 2.0, ceiling: float = 0.0) -> tuple[float, DataFrame, DataFrame]:
    """(threshold, twins, counts) with the threshold raised until enough rows have a twin.

    The threshold starts as given, goes on from 0.11 if that is 0, and grows by a tenth at a time until
    max(floor(ceiling * rows), 2) rows have another within it. counts: rows (threshold, n_twins) of the
    steps. Every row's distance to its nearest neighbour is found once; the steps then only count.
    """
    metric = {1.0: "cityblock", 2.0: "euclidean", float("inf"): "chebyshev"}.get(float(order), "minkowski")
    same = df.select(row_id, *features, F.lit(0.0).alias("__y"))
    near = Kept(neighbours.nearest(same, same, row_id, features, "__y", 1, metric, skip_self=True, p=order).select(row_id, "distance"), "twins")
    found = near.df.agg(F.count("*").alias("n"), F.max("distance").alias("most")).first()
    want = max(int(ceiling * df.count()), 2)
    steps = [float(threshold)]
    while found.most is not None and steps[-1] < found.most:
        steps.append((steps[-1] if steps[-1] > 0 else 0.1) * 1.1)
    place = F.size(F.filter(F.array(*[F.lit(t) for t in steps]), lambda t: t < F.col("distance")))  # a logarithm of the largest distance
    per = {r.k: r.n for r in near.df.groupBy(place.alias("k")).agg(F.count("*").alias("n")).collect()}
    counts, total = [], 0
    for k, t in enumerate(steps):
        total += per.get(k, 0)
        counts.append((t, total))
        if total >= want:
            break
    table = df.sparkSession.createDataFrame(counts, "threshold double, n_twins bigint")
    return counts[-1][0], near.df.where(F.col("distance") <= counts[-1][0]).select(row_id), table


def leave_out_twins(df: DataFrame, row_id: str, features: list[str], threshold: float = 0.0, order: float = 2.0) -> DataFrame:
    """Two splits: train on rows without twins and test on twins, and the other way round."""
    marked = df.select(row_id).join(twins(df, row_id, features, threshold, order).withColumn("__twin", F.lit(True)), row_id, "left")
    twin = F.coalesce("__twin", F.lit(False))
    each = F.array(F.struct(F.lit(0).alias("split"), F.when(twin, "test").otherwise("train").alias("role")), F.struct(F.lit(1).alias("split"), F.when(twin, "train").otherwise("test").alias("role")))
    return marked.select(row_id, F.inline(each)).select("split", row_id, "role", F.lit(1).alias("weight"))


def close_compositions(fractions: DataFrame, formula: str, threshold: float = 0.1) -> DataFrame:
    """Rows (split, member): for each formula as a split, the formulas whose element fractions lie within an L2 distance.

    The members' rows are the split's test set, all other rows train. fractions: (formula, element,
    fraction), distinct formulas. Exact for every threshold above 0, along three routes:

    * Close vectors differ by the threshold at most in every element. So a formula's largest element
      is matched with neighbouring cells of the others' fractions of it, in both directions.
    * What remains are pairs of flat formulas (no fraction above the threshold) that lack one another's
      largest element. Those with a common element are matched by it.
    * Two formulas whose squared norms add up to the squared threshold at most are close whatever they
      have in common; they are found by cells of their norms, and each such pair is a result.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    limit = threshold**2 + 1e-12
    cell = lambda x: F.floor(x / F.lit(threshold)).cast("bigint")
    top = fractions.groupBy(formula).agg(F.max(F.struct("fraction", "element")).alias("t"), F.sum(F.col("fraction") * F.col("fraction")).alias("aa"))
    a = top.select(F.col(formula).alias("split"), "t.element", cell(F.col("t.fraction")).alias("cell"))
    b = fractions.select(F.col(formula).alias("member"), "element", F.explode(F.array(*[cell(F.col("fraction")) + d for d in (-1, 0, 1)])).alias("cell"))
    one = a.join(b, ["element", "cell"]).select("split", "member")

    flat = top.where(F.col("t.fraction") <= threshold + 1e-12).select(formula)
    few = fractions.join(flat, formula, "left_semi").select(formula, "element")
    common = few.select(F.col(formula).alias("split"), "element").join(few.select(F.col(formula).alias("member"), "element"), "element").select("split", "member")

    # the norms' cells are of a sixteenth of the squared threshold; cells that add up to more can't meet it
    cells = 16
    normed = top.where(F.col("aa") <= limit).select(formula, "aa", F.floor(F.col("aa") / F.lit(limit) * cells).cast("int").alias("c"))
    left = normed.select(F.col(formula).alias("split"), F.col("aa").alias("sa"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(cells) - F.col("c"), F.lit(0)))).alias("c"))
    right = normed.select(F.col(formula).alias("member"), F.col("aa").alias("ma"), "c")
    small_norms = left.join(right, "c").where(F.col("sa") + F.col("ma") <= limit).select("split", "member")

    swapped = one.select(F.col("member").alias("split"), F.col("split").alias("member"))
    pairs = one.unionByName(swapped).unionByName(common).distinct()
    norm = lambda name, value: top.select(F.col(formula).alias(name), F.col("aa").alias(value))
    f = fractions.select(F.col(formula).alias("split"), "element", F.col("fraction").alias("x"))
    g = fractions.select(F.col(formula).alias("member"), "element", F.col("fraction").alias("y"))
    dots = pairs.join(norm("split", "aa"), "split").join(norm("member", "bb"), "member").join(f, "split").join(g, ["member", "element"]).groupBy("split", "member", "aa", "bb").agg(F.sum(F.col("x") * F.col("y")).alias("ab"))
    return dots.where(F.col("aa") + F.col("bb") - 2 * F.col("ab") <= limit).select("split", "member").unionByName(small_norms).distinct()


def cluster_folds(df: DataFrame, row_id: str, features: list[str], k: int, method: str = "KMeans", seed: int = 1) -> DataFrame:
    """(row_id, fold) from a clustering: KMeans, BisectingKMeans or GaussianMixture."""
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
    from pyspark.ml.feature import VectorAssembler

    kinds = {"KMeans": KMeans, "BisectingKMeans": BisectingKMeans, "GaussianMixture": GaussianMixture}
    if method not in kinds:
        raise ValueError(f"no clustering {method!r}; there are {', '.join(kinds)}")
    ready = VectorAssembler(inputCols=features, outputCol="__f").transform(df)
    model = kinds[method](k=k, seed=seed, featuresCol="__f", predictionCol="fold").fit(ready)
    return model.transform(ready).select(row_id, "fold")


def force_train(splits: DataFrame, forced: DataFrame, row_id: str) -> DataFrame:
    """The split table with further rows that train in every split; a row it tests isn't forced there."""
    every = splits.select("split").distinct()
    more = forced.select(row_id).join(F.broadcast(every)).select("split", row_id, F.lit("train").alias("role"), F.lit(1).alias("weight"))
    return splits.unionByName(more.join(splits.select("split", row_id), ["split", row_id], "left_anti").select("split", row_id, "role", "weight"))


def nested(df: DataFrame, row_id: str, outer: int, inner: int) -> DataFrame:
    """(outer, row_id, inner): outer folds by one hash; for rows outside the outer test fold, inner folds by another.

    inner is null for the rows that the outer split leaves out.
    """
    own = (hash_number(row_id, seed="outer") % outer).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))
    inner_fold = (hash_number("outer", row_id, seed="inner") % inner).cast("int")
    return df.select(row_id, own.alias("__own"), each.alias("outer")).select("outer", row_id, F.when(F.col("__own") != F.col("outer"), inner_fold).alias("inner"))
