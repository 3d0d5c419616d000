"""Operator 7: secret scans with character Markov models.

Base patterns give spans of known forms. Further tokens are scored by two first-order Markov
models whose states are the characters of ALPHABET: one
of random strings, one of ordinary identifiers. A token is a secret if the mean log-likelihood
ratio of its transitions passes a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Base patterns: kind, pattern, cheap pattern that every text with a match has, group and length that a match needs.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones fail whole
)
#: The states of the models, and the tokens that they score.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MODEL_KIND = "random"
#: Labelled samples: generated random strings, and identifiers from at most this many documents.
RANDOM_SAMPLES, SAMPLE_DOCS = 3000, 2000
#: Mean log-likelihood ratio a transition (nats) from which a token counts as random.
THRESHOLD = 0.75
#: Identifiers that any code base has, besides those of the sampled documents.
IDENTIFIERS = (
    "getElementById addEventListener toLowerCase parse_request_headers max_retry_count user_profile_settings "
    "handleSubmitButton configuration_manager application-default-settings internationalization CONNECTION_TIMEOUT_SECONDS "
    "build/output/directory src/main/resources test_parser_returns_none createObjectFromTemplate "
    "content-type-options index_of_last_element README_first_then_install version_number_string"
).split(" ")


def _interleave(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """array<struct<start, end, g...>> of all matches, leftmost first, in code points.

    A text is gap, match, gap, match, ..., gap; the lengths add up to the places.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    more = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups if g]
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), F.transform(matches, lambda m: F.length(m)).alias("len"), *[F.transform(m, lambda x: F.length(x)).alias("inner") for m in more])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,inner:int>>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        begin = acc["at"] + z["gap"]
        end = begin + z["len"]
        inner = z["inner"] if more else z["len"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), inner.alias("inner")))).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    found = F.filter(_interleave(text, pattern, (group,)), lambda s: s["inner"] >= least)
    spans = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS)).cast(_SPANS)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with one array of spans for each base kind."""
    text = F.col("text")
    return docs.select("doc_id", text_of(docs).alias("text")).select("doc_id", "text", *[_spans(text, k, kind, pattern, group, least).alias(kind) for k, (kind, pattern, group, least) in enumerate(BASE)])


# ---------------------------------------------------------------- models
def random_samples(spark: SparkSession, n: int = RANDOM_SAMPLES) -> DataFrame:
    """Labelled random strings: base64, base64url, hex and upper-case digits of SHA-2 sums."""
    digest = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest("b64")))
    forms = F.array(b64, F.translate(b64, "+/=", "-_"), F.substring(digest("hex"), 1, 40), F.upper(F.substring(F.translate(b64, "+/=", ""), 1, 24)))
    return spark.range(n).select(F.explode(forms).alias("token"))


def identifier_samples(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled identifiers: words of letters, identifiers with numbers made of them, and the list IDENTIFIERS.

    The words come from a bounded sample of documents, the `most` rows with the least hashes of their
    doc_id and text, so it is the same in every run. Words with digits are left out, for they may be
    secrets themselves; what ordinary identifiers look like that have digits is known from joining words
    with counters, dates, versions and sizes, as file names, tables and tags do.
    """
    few = docs.select("doc_id", "text").orderBy(F.xxhash64(F.col("doc_id").cast("string"), "text"), "doc_id").limit(most)
    words = F.array_distinct(F.filter(F.split(text_of(few), r"[^A-Za-z0-9+/_=-]+"), lambda w: w.rlike("^[A-Za-z_/-]{4,}$")))
    listed = docs.sparkSession.range(200).select(F.explode(F.array(*[F.lit(w) for w in IDENTIFIERS])).alias("token"))
    named = few.select(words.alias("w")).unionByName(listed.select(F.array("token").alias("w")))
    return few.select(F.explode(words).alias("token")).unionByName(listed).unionByName(named.select(F.explode(F.transform("w", lambda w, i: numbered(w, F.coalesce(F.get("w", i + 1), w)))).alias("token")))


def numbered(word: Column, other: Column) -> Column:
    """An identifier with numbers made of two words, in one of the ways below, by their hash."""
    h = F.xxhash64(word, other)
    number = lambda at, least, count: (F.pmod(F.shiftright(h, at), F.lit(count)) + least).cast("string")
    two = lambda at, count: F.lpad(number(at, 1, count), 2, "0")
    date = F.concat(number(5, 1990, 45), F.lit("-"), two(12, 12), F.lit("-"), two(17, 28))
    ways = (
        F.concat(date, F.lit("_"), word, F.lit("_"), other),
        F.concat(word, F.lit("-"), other, F.lit("-"), F.translate(date, "-", "")),
        F.concat(word, F.lit("_v"), number(5, 0, 30), F.lit("_"), number(12, 0, 20), F.lit("_"), other),
        F.concat(word, F.lit("_"), F.lpad(number(5, 0, 10_000), 5, "0"), F.lit("_"), other),
        F.concat(other, word, F.lit("-"), number(5, 1, 2000), F.lit("x"), number(20, 1, 2000)),
        F.concat(word, number(5, 1, 64), F.lit("/"), other, F.lit("/"), number(20, 1, 100_000)),
    )
    way = F.pmod(h, F.lit(len(ways)))
    return F.coalesce(*[F.when(way == k, x) for k, x in enumerate(ways)])


def transitions(samples: DataFrame) -> DataFrame:
    """Counts (cell, n) of the transitions a -> b; cell = place(a) * |alphabet| + place(b)."""
    return samples.select(F.explode(_cells(F.col("token"))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


def _cells(token: Column) -> Column:
    """The cells of a token's transitions; characters outside the alphabet take no part."""
    places = F.filter(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda p: p >= 0)
    return F.zip_with(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: a * len(ALPHABET) + b)


def train(docs: DataFrame) -> list[float]:
    """The log-likelihood ratio of every transition, random against ordinary, as |alphabet|**2 values.

    Add-one smoothing within each row. The table's size is fixed by the alphabet.
    """
    k = len(ALPHABET)
    tables = []
    both = transitions(random_samples(docs.sparkSession)).withColumn("model", F.lit(0)).unionByName(transitions(identifier_samples(docs)).withColumn("model", F.lit(1)))
    counts = {(r.model, r.cell): r.n for r in both.collect()}  # at most 2 |alphabet|**2 rows
    for model in (0, 1):
        table = []
        for a in range(k):
            row = [counts.get((model, a * k + b), 0) + 1 for b in range(k)]
            total = sum(row)
            table += [math.log(x / total) for x in row]
        tables.append(table)
    return [round(a - b, 6) for a, b in zip(*tables, strict=True)]


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of the token's transitions; null below two characters."""
    cells = _cells(token)
    return F.aggregate(cells, F.lit(0.0), lambda total, c: total + F.get(table, c)) / F.nullif(F.size(cells), F.lit(0))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, counts of base spans, their digest, and all spans.

    A span is kind:start:end in code points, end exclusive, over the whole match. The models' spans
    have the kind `random`; they are tokens of 20 characters or more with a digit and a letter
    that no base span touches. A null text counts as empty; a text without spans has the digest
    of the empty string.
    """
    table = F.split(F.lit(",".join(map(str, train(docs)))), ",").cast("array<double>")
    base = base_spans(docs)
    text = F.col("text")
    tokens = _interleave(text, TOKEN, ())
    starts = F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), F.lit(len(BASE)).alias("rank"), s["end"].alias("end"), F.lit(MODEL_KIND).alias("kind")))
    # a token with a digit and a letter is rare: only texts that have one are looked at further
    mixed = text.rlike(r"[A-Za-z+/_=-][0-9]|[0-9][A-Za-z+/_=-]") & text.rlike(TOKEN)
    base = base.withColumn("found", F.when(mixed, starts).otherwise(F.array().cast(_SPANS)).cast(_SPANS))
    every = F.array_sort(F.concat(*[F.col(kind) for kind, *_ in BASE]))
    base = base.withColumn("base", every)
    clear = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    piece = lambda s: F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    secret = lambda s: clear(s) & piece(s).rlike("[0-9]") & piece(s).rlike("[A-Za-z]") & (ratio(piece(s), table) >= THRESHOLD)
    scored = base.withColumn("found", F.filter("found", secret))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select(
        "doc_id", *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("bigint").alias("n_random"),
    )
