"""Operator 4: benchmark decontamination by SimHash of item-sized windows.

A document is contaminated by a benchmark item if one of its windows, as many shingles long as
the item, is similar to it. Shingles are five words; a window's and an item's fingerprints are
compared through multi-index Hamming blocks, and candidates by the exact weighted similarity
of their shingle bags (sum of the lesser counts over the sum of the greater).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, hamming, settle, shingle_hashes, simhash, small, split_words, stage, text_of

SHINGLE = 5
SIMILARITY = 0.8
#: Eight blocks of eight bits with up to two changed bits each: every pair within 8 * 3 - 1 = 23 bits
#: agrees in a block's neighbourhood. Bags of similarity 0.8 differ in about ten bits.
BLOCKS, FLIPS = 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Bits of the filter that spares documents without any shingle of the benchmark (a power of two).
FILTER_BITS = 1 << 20


def shingles(df: DataFrame, key: str) -> DataFrame:
    """Rows (key, hs): XXH64 hashes of the text's shingles in order; fewer than five words make one."""
    words = split_words(F.lower(text_of(df)), NON_WORD)
    return df.select(key, words.alias("w")).select(key, shingle_hashes(F.col("w"), SHINGLE).alias("hs"))


def _filter_words(items: DataFrame) -> Column:
    """The bits of the shingle filter as a constant array of 64-bit words.

    Its size is fixed by FILTER_BITS, whatever the benchmark's size. It only lets more positions
    through as it fills; the join that follows is exact.
    """
    slots = items.select(F.explode("hs").alias("h")).select(F.explode(F.array(*_slots(F.col("h")))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)))).alias("bits"))
    table = [0] * (FILTER_BITS >> 6)
    for r in words.collect():
        table[r["at"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _slots(h: Column) -> list[Column]:
    mask = F.lit(FILTER_BITS - 1)
    return [h.bitwiseAND(mask).cast("int"), F.shiftrightunsigned(h, 32).bitwiseAND(mask).cast("int")]


def _shift_right(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def _may_hold(table: Column, h: Column) -> Column:
    hit = lambda slot: _shift_right(F.get(table, F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1
    a, b = _slots(h)
    return hit(a) & hit(b)


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255)).cast("int")


def _flips() -> list[int]:
    bits = [1 << i for i in range(64 // BLOCKS)]
    return [sum(c) for r in range(FLIPS + 1) for c in itertools.combinations(bits, r)]


def similarity(a: Column, b: Column) -> Column:
    """Sum of lesser counts over sum of greater counts of two bags of hashes."""
    plain = (F.size(a) == F.size(F.array_distinct(a))) & (F.size(b) == F.size(F.array_distinct(b)))
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    bags = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(bags)
    return shared / (F.size(a) + F.size(b) - shared)


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Candidate windows (doc_id, start, n, window).

    Of all windows of n shingles, those suffice that start at a shingle of the benchmark (or end
    with the document): moving any other window on to its next such shingle loses nothing that it
    shares with an item. A window that shares no shingle can't reach the similarity.
    """
    longest = items.agg(F.max(F.size("hs"))).first()[0] or 0
    sizes = items.select(F.size("hs").alias("n"), F.explode("hs").alias("h")).groupBy("h").agg(F.collect_set("n").alias("sizes"))
    sizes = stage(sizes, "sizes")
    table = _filter_words(items)
    own = shingles(docs, "doc_id")
    hits = own.select("doc_id", "hs", F.filter(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: _may_hold(table, F.get(F.col("hs"), i))).alias("hits"))
    hits = settle(hits, "hs", "hits").where("size(hits) > 0")
    at = hits.select("doc_id", "hs", F.explode("hits").alias("at"))
    first = F.greatest(F.least(F.col("at"), F.size("hs") - longest), F.lit(0))
    near = at.select("doc_id", "at", F.get("hs", F.col("at")).alias("h"), first.alias("first"), F.size("hs").alias("all"), F.slice("hs", first + 1, F.lit(max(longest, 1))).alias("part"))
    met = near.join(small(sizes, sizes.count()), "h").select("doc_id", "at", "first", "all", "part", F.explode("sizes").alias("n"))
    start = F.greatest(F.least(F.col("at"), F.col("all") - F.col("n")), F.lit(0))
    return met.select("doc_id", start.alias("start"), "n", F.slice("part", start - F.col("first") + 1, F.col("n")).alias("window"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, start, n_shingles, differing_bits, similarity), the best window of each pair.

    start counts shingles from 0. Ties go to the first window that starts with a shared shingle. Texts are lower-cased; words are
    runs of letters, digits and non-ASCII characters. Null and empty texts match nothing; an item
    of fewer than five words matches a document that consists of the same words.
    """
    items = stage(shingles(benchmark, "item_id").where("size(hs) > 0"), "items")
    found = windows(docs, items).withColumn("fp", simhash(F.col("window")))
    theirs = items.select("item_id", "hs", F.size("hs").alias("n"), simhash(F.col("hs")).alias("item_fp"))
    flips = F.array(*[F.lit(x) for x in _flips()])
    probes = theirs.select("item_id", "hs", "n", "item_fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _block(F.col("item_fp"), k).alias("v")) for k in range(BLOCKS)])).alias("b"))
    probes = stage(probes.select("item_id", "n", "item_fp", "b.k", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("b.v")))).alias("v")), "probes")
    keys = found.select("*", F.posexplode(F.array(*[_block(F.col("fp"), k) for k in range(BLOCKS)])).alias("k", "v"))
    met = keys.join(small(probes, probes.count()), ["n", "k", "v"]).withColumn("differing_bits", hamming(F.col("fp"), F.col("item_fp"))).where(F.col("differing_bits") <= RADIUS)
    # a pair that agrees in several blocks counts in the first of them
    agree = lambda k: F.bit_count(_block(F.col("fp"), k).bitwiseXOR(_block(F.col("item_fp"), k))) <= FLIPS
    first = F.coalesce(*[F.when(agree(k), F.lit(k)) for k in range(BLOCKS)])
    met = met.where(F.col("k") == first).drop("k", "v")
    bags = items.select("item_id", "hs")
    scored = met.join(small(bags, items.count(), 20_000), "item_id").withColumn("similarity", similarity(F.col("window"), F.col("hs"))).where(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n", "differing_bits")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.before")).alias("start"), F.col("m.n").alias("n_shingles"), "m.differing_bits", "m.similarity")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item.

    Rows with an id go if a text of that id matches. Rows without one can't be told apart by id, so
    those are told by the hash of their text.
    """
    name = lambda doc_id, text: F.struct(doc_id.cast("string"), F.when(doc_id.isNull(), F.xxhash64(text)))
    named = docs.select(name(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")
    bad = stage(matches(named, benchmark).select(F.col("doc_id").alias("__bad")).distinct(), "bad")
    # a struct of nulls equals itself, so null parts need no care
    return docs.join(small(bad, bad.count()), name(docs["doc_id"], docs["text"]).eqNullSafe(F.col("__bad")), "left_anti").select(*docs.columns)
