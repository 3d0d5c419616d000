"""Uncertainty: learners' spread, error bins, likelihood, recalibration, calibration curves."""

from __future__ import annotations

from collections.abc import Generator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import normal
from lattica.functions.scratch import Kept

LOG_2PI = 1.8378770664093453


def drop_outlier_learners(df: DataFrame, learners: str = "learners", n_stdevs: float = 3.0) -> DataFrame:
    """df whose arrays keep the learners within n deviations of their mean, and n_dropped."""
    size = F.size(learners)
    mean = F.aggregate(learners, F.lit(0.0), lambda s, x: s + x, lambda s: s / size)
    out = df.withColumn("__m", mean)
    out = out.withColumn("__s", F.sqrt(F.aggregate(learners, F.lit(0.0), lambda s, x: s + F.pow(x - F.col("__m"), 2), lambda s: s / size)))
    kept = F.filter(learners, lambda x: F.abs(x - F.col("__m")) <= n_stdevs * F.col("__s"))
    return out.withColumn("__k", kept).withColumn("n_dropped", size - F.size("__k")).withColumn(learners, F.col("__k")).drop("__m", "__s", "__k")


def distinct_stdev(df: DataFrame, y: str) -> DataFrame:
    """One row: the population deviation of the distinct values."""
    return df.select(y).distinct().agg(F.stddev_pop(y).alias("dataset_stdev"))


def error_bins(df: DataFrame, n: int = 15, equal_counts: bool = False, sigma: str = "y_err", name: str = "bin") -> DataFrame:
    """df with its bin from 1 to n by sigma: equal widths from the least to the greatest, or equal counts.

    With equal widths the greatest values share the last bin. Rows without a sigma have no bin (null).
    """
    if equal_counts:
        edges = df.agg(F.percentile(sigma, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("__e"))
        place = 1 + F.size(F.filter("__e", lambda e: e <= F.col(sigma)))
    else:
        edges = df.agg(F.min(sigma).alias("__lo"), F.max(sigma).alias("__hi"))
        width = (F.col("__hi") - F.col("__lo")) / n
        place = F.when(width > 0, F.least(F.floor((F.col(sigma) - F.col("__lo")) / width) + 1, F.lit(n))).otherwise(1)
    return df.join(F.broadcast(edges)).select(*df.columns, F.when(F.col(sigma).isNotNull(), place).cast("int").alias(name))  # one row


def bin_statistics(binned: DataFrame, sigma: str = "y_err", residual: str = "residual", by: list[str] | None = None) -> DataFrame:
    """Rows (bin, n, rms, ms, var_sq, sigma_mean)."""
    r2 = F.pow(F.col(residual), 2)
    return binned.groupBy(*(by or []), "bin").agg(F.count("*").alias("n"), F.sqrt(F.avg(r2)).alias("rms"), F.avg(r2).alias("ms"), F.var_pop(r2).alias("var_sq"), F.avg(sigma).alias("sigma_mean"))


def recalibrated(sigma: Column, parameters: list) -> Column:
    """A polynomial of sigma, highest power first; one parameter shifts it."""
    if len(parameters) == 1:
        return sigma + parameters[0]
    out = F.lit(0.0)
    for a in parameters:
        out = out * sigma + a
    return out


def nll(residual: Column, sigma: Column) -> Column:
    """Mean negative log-likelihood of normal residuals; null where a sigma isn't positive."""
    each = F.when(sigma > 0, (LOG_2PI + 2 * F.ln(sigma) + F.pow(residual / sigma, 2)) / 2)
    return F.when(F.count(each) == F.count("*"), F.avg(each))


def _simplex(k: int, rounds: int, tolerance: float) -> Generator[list[np.ndarray], list[float], np.ndarray]:
    """The simplex method of Nelder and Mead (1965): yields points, is sent their values, returns the best.

    Every step asks for all points that it may need at once. For k = 1 it starts from a shift of zero.
    """
    start = np.zeros(k)
    if k > 1:
        start[-2] = 1.0
    simplex = [start] + [start + 0.25 * np.eye(k)[i] for i in range(k)]
    score = yield simplex
    for _ in range(rounds):
        order = np.argsort(score, kind="stable")
        simplex, score = [simplex[i] for i in order], [score[i] for i in order]
        if np.isfinite(score[-1]) and score[-1] - score[0] < tolerance:
            break
        centre, worst = np.mean(simplex[:-1], axis=0), simplex[-1]
        reflected, expanded = 2 * centre - worst, 3 * centre - 2 * worst
        outside, inside = 1.5 * centre - 0.5 * worst, 0.5 * centre + 0.5 * worst
        shrunk = [simplex[0] + (x - simplex[0]) / 2 for x in simplex[1:]]
        r, e, o, i, *s = yield [reflected, expanded, outside, inside, *shrunk]
        if r < score[0]:
            simplex[-1], score[-1] = (expanded, e) if e < r else (reflected, r)
        elif r < score[-2]:
            simplex[-1], score[-1] = reflected, r
        elif min(o, i) < min(r, score[-1]):
            simplex[-1], score[-1] = (outside, o) if o <= i else (inside, i)
        else:
            simplex[1:], score[1:] = shrunk, s
    return simplex[int(np.argmin(score))]


def calibrate(df: DataFrame, power: int = 1, sigma: str = "y_err", residual: str = "residual", rounds: int = 60, tolerance: float = 1e-7) -> list[float]:
    """Parameters that minimise nll, by the simplex method; each step is one aggregation.

    Rows with the same sigma are summed up before, so that a step reads the distinct sigmas only.
    """
    search = _simplex(power + 1, rounds, tolerance)
    points = next(search)
    r2 = F.pow(F.col(residual).cast("double"), F.lit(2))
    sums = Kept(df.groupBy(F.col(sigma).cast("double").alias("s")).agg(F.count("*").alias("n"), F.count(residual).alias("known"), F.sum(r2).alias("r2")), "sigmas")
    while True:
        # points go as a table, so that every step is the same program; as many as the simplex has corners
        asked = sums.df.sparkSession.createDataFrame([([[float(a) for a in x] for x in points],)], "__p array<array<double>>")
        value = lambda i: recalibrated(F.col("s"), [F.get(F.get("__p", F.lit(i)), F.lit(j)) for j in range(power + 1)])
        row = sums.df.join(F.broadcast(asked)).agg(*[_nll_of_sums(value(i)).alias(f"v{i}") for i in range(len(points))]).first()
        try:
            points = search.send([float("inf") if v is None else v for v in row])
        except StopIteration as end:
            sums.drop()
            return [float(x) for x in end.value]


def _nll_of_sums(sigma: Column) -> Column:
    """nll of rows (n, known, r2): numbers of rows, of those with a residual, and sums of squared residuals."""
    each = F.when((sigma > 0) & (F.col("known") == F.col("n")), (F.col("n") * (LOG_2PI + 2 * F.ln(sigma)) + F.col("r2") / (sigma * sigma)) / 2)
    return F.when(F.count(each) == F.count("*"), F.sum(each) / F.sum("n"))


def calibrate_bins(binned: DataFrame, sigma: str = "y_err", residual: str = "residual", rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """Rows (bin, a, b): the line that minimises nll, for every bin by itself.

    The bins' searches go in step: one aggregation by bin serves all of them, so a bin of any size
    is summed in parts. The caller caches the table.
    """
    spark = binned.sparkSession
    searches = {r.bin: _simplex(2, rounds, tolerance) for r in binned.select("bin").distinct().collect()}
    wanted, found = {b: next(s) for b, s in searches.items()}, []
    while wanted:
        width = max(map(len, wanted.values()))
        points = spark.createDataFrame([(b, [[float(a) for a in x] for x in p + [p[0]] * (width - len(p))]) for b, p in wanted.items()], "bin int, __p array<array<double>>")
        value = lambda i: nll(F.col(residual), recalibrated(F.col(sigma), [F.get(F.get("__p", F.lit(i)), F.lit(j)) for j in range(2)]))
        rows = binned.join(F.broadcast(points), "bin").groupBy("bin").agg(*[value(i).alias(f"v{i}") for i in range(width)]).collect()  # a row per bin
        for r in rows:
            scores = [float("inf") if r[f"v{i}"] is None else r[f"v{i}"] for i in range(len(wanted[r.bin]))]
            try:
                wanted[r.bin] = searches[r.bin].send(scores)
            except StopIteration as end:
                found.append((r.bin, *map(float, end.value)))
                del wanted[r.bin]
    return spark.createDataFrame(found, "bin int, a double, b double")


def apply_calibration(binned: DataFrame, parameters: DataFrame, sigma: str = "y_err", name: str = "y_err_cal") -> DataFrame:
    """sigma recalibrated by (bin, a, b); a bin without parameters takes those of the last bin."""
    last = parameters.agg(F.max_by(F.struct("a", "b"), "bin").alias("__last"))
    wide = binned.join(F.broadcast(parameters), "bin", "left").join(F.broadcast(last))  # a row per bin, and one row
    return wide.withColumn(name, F.coalesce("a", "__last.a") * F.col(sigma) + F.coalesce("b", "__last.b")).drop("a", "b", "__last")


def average_parameters(df: DataFrame, by: str = "bin") -> DataFrame:
    """Means and population deviations of parameters (a, b) over splits, per bin."""
    return df.groupBy(by).agg(*[f(c).alias(f"{c}_{k}") for c in ("a", "b") for k, f in (("mean", F.avg), ("stdev", F.stddev_pop))])


def r_statistic(df: DataFrame, sigma: str = "y_err", residual: str = "residual") -> DataFrame:
    """df without zero sigmas, with r = residual / sigma."""
    return df.where(F.col(sigma) != 0).withColumn("r", F.col(residual) / F.col(sigma))


def r_summary(df: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    """Rows (by, n, r_mean, r_stdev)."""
    return df.groupBy(*by).agg(F.count(r).alias("n"), F.avg(r).alias("r_mean"), F.stddev_pop(r).alias("r_stdev"))


def calibration_curve(df: DataFrame, r: str = "r", points: int = 101, by: list[str] | None = None) -> DataFrame:
    """Rows (by, level, expected, observed): the normal distribution function at levels from -4 to 4, and the share of r below.

    Each row adds to one counter, and the counters are summed up along the levels, for each group by itself.
    """
    keys, step = by or [], 8.0 / (points - 1)
    place = F.least(F.greatest(F.ceil((F.col(r) + 4) / step), F.lit(0)), F.lit(points))
    counts = df.where(F.col(r).isNotNull()).groupBy(*keys, place.cast("int").alias("i")).agg(F.count("*").alias("n"))
    # a counter of zero for every level, and one beyond the last
    grid = counts.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = grid.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i"), F.lit(0).cast("bigint").alias("n"))
    both = counts.unionByName(grid).groupBy(*keys, "i").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))  # as many rows as there are points
    level = F.col("i") * step - 4
    summed = both.withColumn("upto", F.sum("n").over(group.orderBy("i"))).withColumn("all", F.sum("n").over(group))
    return summed.where(F.col("i") < points).select(*keys, level.alias("level"), normal.cdf(level).alias("expected"), (F.col("upto") / F.nullif("all", F.lit(0))).alias("observed"))


def miscalibration_area(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area between the curves over the expected shares, by trapezoids."""
    along = Window.partitionBy(*(by or [F.lit(0)])).orderBy("level")
    gap = F.abs(F.col("observed") - F.col("expected"))
    pieces = curve.select(*(by or []), ((gap + F.lag(gap).over(along)) / 2 * (F.col("expected") - F.lag("expected").over(along))).alias("piece"))
    return pieces.groupBy(*(by or [])).agg(F.sum("piece").alias("area"))


def residual_against_error(bins: DataFrame, least: int = 30) -> DataFrame:
    """One row: weighted line of rms over sigma_mean, weights n, its R2, and how many bins have more than `least` rows."""
    w, x, y = F.col("n").cast("double"), F.col("sigma_mean"), F.col("rms")
    s = bins.agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.sum(w * y * y).alias("yy"), F.count_if(F.col("n") > least).alias("well_sampled"))
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) / F.col("w") for a, b, c in (("xx", "x", "x"), ("xy", "x", "y"), ("yy", "y", "y")))
    slope = sxy / F.nullif(sxx, F.lit(0.0))
    return s.select(slope.alias("slope"), ((F.col("y") - slope * F.col("x")) / F.col("w")).alias("intercept"), (sxy * sxy / F.nullif(sxx * syy, F.lit(0.0))).alias("r2"), "well_sampled")


def with_standard_errors(bins: DataFrame) -> DataFrame:
    """Standard error of each bin's rms: sqrt(var) / (2 sqrt(n) rms), 1 for bins of one row."""
    return bins.withColumn("rms_se", F.when((F.col("n") <= 1) | (F.col("rms") == 0), F.lit(1.0)).otherwise(F.sqrt("var_sq") / (2 * F.sqrt("n") * F.col("rms"))))
