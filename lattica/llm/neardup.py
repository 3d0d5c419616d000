"""Operator 5: SimHash near-duplicate detection with pigeonhole blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, discard, near_components, simhash, small, split_words, stage, text_of

#: Words of a shingle, and bits in which linked fingerprints may differ.
SHINGLE, RADIUS = 4, 4


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fp, component_id) of documents (doc_id, text), one for each input row.

    component_id is the least doc_id that links of at most `radius` differing bits reach. A null
    text counts as empty; texts without words have fingerprint zero and link like any other. Rows
    without a doc_id take part with a null id. Repeated rows are kept.

    Documents are reduced to distinct fingerprints first, so exact copies cost one node.
    """
    words = split_words(ascii_lower(text_of(docs)), SPACE)
    k = SHINGLE
    one = F.array(F.xxhash64(F.array_join("w", " ")))
    shingles = F.when(F.size("w") > k, F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))).when(F.size("w") > 0, one).otherwise(F.array().cast("array<bigint>"))
    prints = stage(docs.select("doc_id", words.alias("w")).select("doc_id", shingles.alias("h")).select("doc_id", simhash(F.col("h")).alias("fp")), "prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = near_components(distinct.select(F.col("fp").alias("id"), "fp"), radius)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stage(rooted.join(ids, "root").select("fp", "component_id"), "by_print")
    discard(distinct, roots)
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents of which each group keeps that with the least doc_id.

    Rows that share the kept doc_id all stay, and so do rows without a doc_id.
    """
    found = classes(docs.select("doc_id", "text"), radius)
    gone = stage(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
