"""Operator 1: mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a in [0, 1] and normalised: w = p**a / sum(p**a).
a = 1 keeps the corpus as it is, a = 0 gives every source the same weight. Bisection finds the
greatest exponent that meets a target entropy, or the least that respects a repetition limit.
The weights are then realised as budgets: every source's documents are laid out in a seeded
permutation, repeated in passes until its budget is used, and dealt to output blocks so that each
block holds every source in proportion to its weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, small, split_words, stage, text_of

#: Share of the way from the corpus' entropy to that of equal weights, and most passes over a source.
ENTROPY, REPEATS = 0.5, 4.0
#: Documents that a permutation block holds on average if one source has all of them.
BLOCK_ROWS = 512
#: Tokens of an output block.
BLOCK_TOKENS = 16_384
#: Bisection levels that one pass over the source totals settles, and passes.
LEVELS, PASSES = 5, 8


def n_tokens(docs: DataFrame) -> Column:
    """Words between white space; a null text has none."""
    return F.size(split_words(text_of(docs), SPACE)).cast("bigint")


def _bisect(totals: DataFrame, value: list, good) -> tuple[float, float]:
    """Halve [0, 1] LEVELS * PASSES times; `good` says whether an exponent's aggregates are on the lower side.

    Every pass evaluates all exponents that LEVELS halvings may ask for in one aggregation over
    the sources, so the sources themselves never come to the driver.
    """
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        n = 2**LEVELS
        grid = [lo + (hi - lo) * i / n for i in range(1, n)]
        row = totals.agg(*[f(a).alias(f"v{k}_{i}") for i, a in enumerate(grid) for k, f in enumerate(value)]).first()
        a, b = 0, n
        while b - a > 1:
            mid = (a + b) // 2
            if good(grid[mid - 1], *[row[f"v{k}_{mid - 1}"] for k in range(len(value))]):
                a = mid
            else:
                b = mid
        lo, hi = lo + (hi - lo) * a / n, lo + (hi - lo) * b / n
    return lo, hi


def exponent(totals: DataFrame, budget: float, entropy: float | None = ENTROPY, repeats: float | None = REPEATS) -> float:
    """The exponent for source totals (source, tokens) with tokens > 0.

    entropy: target as the share of the way from the entropy at a = 1 to that at a = 0.
    repeats: most passes over any source; it takes precedence over the entropy. A budget of more
    than `repeats` passes over the whole corpus can't be met, then a = 1 (every source alike).
    """
    row = totals.agg(F.count("*").alias("s"), F.sum("tokens").alias("t"), F.min("tokens").alias("least")).first()
    if not row.s or row.s == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(row.t))
    z = lambda a: F.sum(F.pow(share, F.lit(a)))
    zlog = lambda a: F.sum(F.pow(share, F.lit(a)) * F.ln(share))
    h = lambda a, zz, zl: math.log(zz) - a * zl / zz
    a = 1.0
    if entropy is not None:
        one = totals.agg(z(1.0).alias("z"), zlog(1.0).alias("l")).first()
        low, high = h(1.0, one.z, one.l), math.log(row.s)
        target = low + entropy * (high - low)
        if high - low > 1e-12:
            a = _bisect(totals, [z, zlog], lambda x, zz, zl: h(x, zz, zl) >= target)[0]
    if repeats is not None:
        # passes over the smallest source, whose weight gains most: w / share * budget / total
        p = row.least / row.t
        passes = lambda x, zz: p**x / zz * budget / (row.t * p)
        now = totals.agg(z(a).alias("z")).first().z
        if passes(a, now) > repeats:
            a = max(a, _bisect(totals, [z], lambda x, zz: passes(x, zz) > repeats)[1])
    return a


def weights(totals: DataFrame, a: float, budget: float) -> DataFrame:
    """Rows (source, tokens, weight, budget): normalised weights and token budgets."""
    total = totals.agg(F.sum("tokens")).first()[0] or 1
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    return totals.select("source", "tokens", (power / F.lit(z)).alias("weight"), (power / F.lit(z) * F.lit(float(budget))).alias("budget"))


def mix(docs: DataFrame, budget: float | None = None, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, seed: int = 1) -> DataFrame:
    """The mixed corpus: docs' columns, and (n_tokens, weight, epoch, out_block, order_key).

    One row for each use of a document. budget: tokens of the mixture, those of the corpus if
    None. epoch counts the passes over the source from 0; out_block the output blocks; order_key
    orders a block's rows at random. Of a source's last pass, the documents are used that fit whole
    into its budget in permutation order; a source with a budget below its first document gives
    none. Null sources are one source. A document without tokens is used in each pass that reaches its
    place in the permutation; sources without any token give no rows. Columns of docs with the names
    of the added ones give way. Repeated rows are used each.

    No step groups by source alone: a source's permutation is cut into blocks of bounded size
    by the documents' hashes, and block sums give every block its place.
    """
    added = ("n_tokens", "weight", "epoch", "out_block", "order_key")
    cols = [c for c in docs.columns if c not in added]
    rows = docs.count()
    bits = max(0, math.ceil(math.log2(max(1, rows / BLOCK_ROWS))))
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.octet_length(text_of(docs)))
    block = F.shiftrightunsigned(hashed, 64 - bits).cast("int") if bits else F.lit(0)
    laid = docs.select(*cols, n_tokens(docs).alias("n_tokens"), hashed.alias("__h"), block.alias("__b"))
    sums = stage(laid.groupBy("source", "__b").agg(F.sum("n_tokens").alias("tokens")), "blocks")

    totals = stage(sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "totals")
    corpus = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = float(corpus if budget is None else budget)
    plan = weights(totals, exponent(totals, budget, entropy, repeats), budget).withColumnRenamed("source", "__s")

    # prefix sums over a source's blocks in two levels, so that no task holds all of them
    group = F.shiftright("__b", 10)
    upper = sums.groupBy("source", group.alias("__g")).agg(F.sum("tokens").alias("in_group"))
    upper = upper.select(F.col("source").alias("__s"), "__g", (F.sum("in_group").over(Window.partitionBy("source").orderBy("__g")) - F.col("in_group")).alias("over"))
    inner = Window.partitionBy("source", "__g").orderBy("__b")
    lower = sums.withColumn("__g", group).withColumn("before", F.sum("tokens").over(inner) - F.col("tokens"))
    same = lambda df: F.col("source").eqNullSafe(df["__s"])
    placed = lower.join(upper.withColumnRenamed("__g", "__u"), same(upper) & (F.col("__g") == F.col("__u"))).drop("__s")
    plan_rows = totals.count()
    placed = placed.join(small(plan.withColumnRenamed("tokens", "all"), plan_rows), F.col("source").eqNullSafe(F.col("__s")))
    placed = stage(placed.select("source", "__b", (F.col("before") + F.col("over")).alias("before"), "all", "weight", "budget"), "placed")
    lookup = placed.withColumnsRenamed({"source": "__s", "__b": "__pb"})
    lookup = small(lookup, placed.count(), 50_000)

    order = Window.partitionBy("source", "__b").orderBy("__h", "doc_id", "n_tokens")
    ranked = laid.withColumn("upto", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = ranked.join(lookup, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__pb")))
    end = F.col("before") + F.col("upto")
    passes = F.floor(F.col("budget") / F.col("all"))
    rest = F.col("budget") - passes * F.col("all")
    uses = (passes + F.when(end <= rest + 1e-6, 1).otherwise(0)).cast("int")
    used = joined.withColumn("uses", uses).where("uses > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    n_blocks = max(1, math.ceil(budget / BLOCK_TOKENS))
    at = (F.col("epoch") * F.col("all") + end - F.col("n_tokens")) / F.col("budget")
    out_block = F.least(F.floor(at * n_blocks), F.lit(n_blocks - 1)).cast("bigint")
    discard(sums)
    return used.select(*cols, "n_tokens", "weight", "epoch", out_block.alias("out_block"), F.xxhash64(F.lit(seed), "__h", "doc_id", "epoch").alias("order_key"))
