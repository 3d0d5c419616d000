"""Operator 8: quality rules with thresholds from mergeable quantile sketches.

Every document gets a few measures. Per language and source, each measure's distribution is
sketched as counts of logarithmic bins (DDSketch, Masson et al. 2019): a quantile's relative error
is bounded by ALPHA, sketches merge by adding counts, and the result does not depend on the order
of merging. Thresholds are outer quantiles of the group's own distribution, drawn towards those of all
documents where the group is small; the documents are filtered by a join with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, settle, small, split_words, stage, text_of

#: Relative error of a sketched quantile.
ALPHA = 0.01
#: Documents that the merged sketch of all documents counts for beside a group's own: quantiles are
#: drawn towards those of all by the weight PRIOR / (n + PRIOR).
PRIOR = 100
#: Measures, and the quantiles (in thousandths) below and beyond which a document of the group fails.
MEASURES: dict[str, tuple[int | None, int]] = {"symbol_ratio": (None, 950), "word_length": (20, 980), "dup_line_ratio": (None, 995)}
#: Base rules: fewest words, and the largest share of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Repeated windows up to which a scan per window is cheaper than a sort.
FEW = 24

_GAMMA = (1 + ALPHA) / (1 - ALPHA)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 4, windows).otherwise(F.array().cast("array<bigint>"))


def _covered(positions: Column) -> Column:
    """Words under 3-word windows that start at these ascending positions."""
    gaps = F.zip_with(F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0))), F.slice(positions, 1, F.greatest(F.size(positions) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    return F.aggregate(gaps, F.lit(3), lambda total, g: total + g).cast("bigint")


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the ratios.

    A null text has no words. All counts are over whole texts.
    """
    text = text_of(docs)
    kept = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", *MEASURES, "__w", "__l", "__h", "__r", "__p")]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(
        *kept,
        split_words(text, SPACE).alias("__w"),
        lines.alias("__l"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
    )
    step = step.select(*kept, F.size("__w").cast("bigint").alias("n_words"), "word_chars", "n_symbols", F.size("__l").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"), _repeat_words(F.col("__w")).alias("__h"))
    # the windows' hashes that occur again, from the sorted hashes
    again = F.when(F.size("__h") > F.size(F.array_distinct("__h")), F.sort_array("__h")).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("__p", again)
    step = step.withColumn("__r", F.array_distinct(F.filter("__p", lambda x, i: (i > 0) & (x == F.get(F.col("__p"), i - 1)))))
    where = F.sequence(F.lit(0), F.size("__h") - 1)
    by_scan = F.filter(where, lambda i: F.array_contains(F.col("__r"), F.get(F.col("__h"), i)))
    placed = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__p", F.when(F.size("__r") > FEW, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    near = lambda i: F.get(F.col("__p"), i)["h"]
    by_sort = F.sort_array(F.transform(F.filter("__p", lambda x, i: ((i > 0) & (near(i - 1) == x["h"])) | F.coalesce(near(i + 1) == x["h"], F.lit(False))), lambda x: x["i"]))
    step = step.withColumn("__p", F.when(F.size("__r") == 0, F.array().cast("array<int>")).when(F.size("__r") <= FEW, by_scan).otherwise(by_sort))
    step = step.withColumn("n_repeat_words", F.when(F.size("__p") == 0, F.lit(0).cast("bigint")).otherwise(_covered(F.col("__p")))).drop("__w", "__l", "__h", "__r", "__p")
    step = step.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol_ratio": F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
            "word_length": F.col("word_chars") / F.greatest("n_words", F.lit(1)),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        }
    )
    return settle(step, *[c for c in step.columns if c not in kept])


def sketch(measured: DataFrame) -> DataFrame:
    """DDSketch bins: rows (lang, source, measure, bin, n) of the documents that pass the base rules; bin null holds zeros.

    Null languages and sources are groups of their own.
    """
    measured = measured.where(~F.col("base_failed"))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in MEASURES]))
    each = measured.select("lang", "source", pairs.alias("p")).select("lang", "source", "p.measure", F.when(F.col("p.x") > 0, F.ceil(F.ln("p.x") / F.ln(F.lit(_GAMMA)))).cast("int").alias("bin"))
    return each.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def _share(side: int) -> Column:
    """The quantile of a row's measure on one side, in thousandths; null if it has none there."""
    return F.coalesce(*[F.when(F.col("measure") == m, F.lit(q[side])) for m, q in MEASURES.items()])


def _quantiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, measure, lo, hi, total) of merged sketches: the outer edges of the bins in which the measure's quantiles lie."""
    merged = bins.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy(F.col("bin").asc_nulls_first()))).withColumn("total", F.sum("n").over(group))
    edge = lambda back: F.coalesce(F.pow(F.lit(_GAMMA), F.col("bin") - back), F.lit(0.0))
    at = lambda side: F.min(F.when(1000 * F.col("upto") >= _share(side) * F.col("total"), edge(1 - side)))
    return ranked.groupBy(*keys, "measure").agg(at(0).alias("lo"), at(1).alias("hi"), F.max("total").alias("total"))


def thresholds(bins: DataFrame) -> DataFrame:
    """Rows (lang, source, <measure>_lo, <measure>_hi) of every group in the sketches.

    A group's quantiles are averaged with those of all documents, weighted by the group's size and
    by PRIOR, so that a group is judged by its own data as far as these go.
    """
    own, everyone = _quantiles(bins, ["lang", "source"]), _quantiles(bins.withColumn("every", F.lit(1)), ["every"])
    everyone = everyone.select("measure", F.col("lo").alias("e_lo"), F.col("hi").alias("e_hi"))
    both = own.join(F.broadcast(everyone), "measure")  # three rows
    drawn = lambda side: ((F.col("total") * F.col(side) + PRIOR * F.col(f"e_{side}")) / (F.col("total") + PRIOR)).alias(side)
    fenced = both.select("lang", "source", "measure", drawn("lo"), drawn("hi"))
    out = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("lo", "hi")]
    return fenced.groupBy("lang", "source").agg(*out)


def verdict() -> Column:
    """Whether a document passes the base rules and its group's thresholds; a group without any has none that passes the base rules."""
    inside = ~F.col("base_failed")
    for m, (low, _) in MEASURES.items():
        inside = inside & (F.col(m) <= F.col(f"{m}_hi"))
        if low is not None:
            inside = inside & (F.col(m) >= F.col(f"{m}_lo"))
    return F.coalesce(inside, F.lit(False))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured joined with its group's thresholds, and `kept`."""
    limits = stage(limits, "thresholds")
    limits = small(limits.withColumnsRenamed({"lang": "__lang", "source": "__source"}), limits.count())
    same = measured["lang"].eqNullSafe(limits["__lang"]) & measured["source"].eqNullSafe(limits["__source"])
    return measured.join(limits, same, "left").drop("__lang", "__source").withColumn("kept", verdict())


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, the ratios and their thresholds.

    The texts are read once; what is kept of them is a narrow table, from which the sketches and
    the verdicts come. An empty table gives no rows; repeated rows each get a row.
    """
    measured = stage(measures(docs.select("doc_id", "lang", "source", "text")).drop("text"), "measured")
    return judge(measured, thresholds(sketch(measured)))


def keep(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is `kept`, all columns as they were.

    The texts are read twice rather than shuffled: once for the sketches, once for the filter.
    """
    limits = thresholds(sketch(measures(docs.select("lang", "source", "text")).drop("text")))
    whole = docs.select("lang", "source", "text", F.struct(*docs.columns).alias("__doc"))
    return judge(measures(whole), limits).where("kept").select("__doc.*")
