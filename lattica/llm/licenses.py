"""Operator 2: licence scans by an exact set-similarity join with licence templates."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, settle, small, split_words, stage, text_of

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates that a text block may contain: usual licence notices, as words.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.9


def as_sets(templates: Sequence[tuple[str, str]]) -> list[tuple[str, list[str], int]]:
    """(label, distinct words, how many of them a block must hold) of every template."""
    out = []
    for label, text in templates:
        tokens = sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())))
        out.append((label, tokens, math.ceil(CONTAINMENT * len(tokens) - 1e-9)))
    return out


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows (template, label, tokens, need)."""
    rows = [{"template": i, "label": label, "tokens": tokens, "need": need} for i, (label, tokens, need) in enumerate(as_sets(templates))]
    parsed = F.from_json(F.lit(json.dumps(rows)), "array<struct<template:int,label:string,tokens:array<string>,need:int>>")
    return spark.range(1).select(F.explode(parsed).alias("t")).select("t.*")


def blocks(docs: DataFrame, vocabulary: Sequence[str], fewest: int) -> DataFrame:
    """Rows (doc_id, block, tokens): a text's lines as sets of the templates' words.

    Words of no template can't add to an overlap, so they are left out of the sets. Lines with
    fewer than `fewest` such words are too short for any template (length filter).
    """
    known = F.array(*[F.lit(w) for w in vocabulary])
    lines = F.split(ascii_lower(text_of(docs)), "\n")
    sets = F.transform(lines, lambda x: F.array_intersect(F.split(x, NON_WORD), known))
    found = F.filter(F.transform(sets, lambda s, i: F.struct(i.alias("block"), s.alias("tokens"))), lambda b: F.size(b["tokens"]) >= fewest)
    return docs.select("doc_id", F.explode(found).alias("b")).select("doc_id", "b.block", "b.tokens")


def contained(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Every (doc_id, block, template, label, overlap, containment) that meets the threshold.

    Exact join (Chaudhuri et al. 2006; Bayardo et al. 2007; Xiao et al. 2008): tokens are ordered
    from the rarest to the most frequent over all blocks; with an overlap of `need`, a block and a
    template share one of the template's first |T| - need + 1 tokens, and the block's first
    |B| - need + 1; the places of a shared token bound the overlap that is still possible.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    local = [(tokens, need) for _, tokens, need in as_sets(templates)]
    vocabulary = sorted({w for tokens, _ in local for w in tokens})
    if not vocabulary:
        return docs.select("doc_id", F.lit(0).alias("block"), F.lit(0).alias("template"), F.lit("").alias("label"), F.lit(0).alias("overlap"), F.lit(0.0).alias("containment")).limit(0)
    found = stage(blocks(docs, vocabulary, min(need for _, need in local)), "blocks")
    counted = found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # at most one row for each word of the templates
    rank = F.broadcast(counted.select("token", F.struct("n", "token").alias("rank")))

    def ordered(df: DataFrame, *keys: str) -> DataFrame:
        each = df.select(*keys, F.explode("tokens").alias("token")).join(rank, "token")
        return each.groupBy(*keys).agg(F.sort_array(F.collect_list("rank")).alias("ranks")).select(*keys, F.transform("ranks", lambda r: r["token"]).alias("tokens"))

    sets = found.groupBy("tokens").agg(F.count("*").alias("copies")).select(F.col("tokens").alias("raw"), "tokens")
    sets = ordered(sets, "raw").withColumn("size", F.size("tokens"))
    whole = table.select("template", "label", "need", F.size("tokens").alias("wide"))
    theirs = ordered(table, "template").join(whole, "template").withColumnRenamed("tokens", "words")
    # words that no block holds are the rarest: they stand before the ordered ones
    theirs = theirs.withColumn("missing", F.col("wide") - F.size("words"))
    left = sets.select("raw", "tokens", "size", F.posexplode("tokens").alias("i", "token"))
    right = theirs.select("template", "label", "need", "wide", "words", F.posexplode("words").alias("j0", "token"), "missing").withColumn("j", F.col("j0") + F.col("missing")).where("j <= wide - need")
    met = left.join(F.broadcast(right), "token").where("size >= need and i <= size - need and 1 + least(size - i - 1, wide - j - 1) >= need")
    overlap = F.size(F.array_intersect("tokens", "words"))
    hits = met.withColumn("overlap", overlap).where("overlap >= need").select("raw", "template", "label", "overlap", (F.col("overlap") / F.col("wide")).alias("containment")).distinct()
    hits = stage(hits, "hits")
    return found.join(small(hits.withColumnRenamed("raw", "tokens"), hits.count(), 20_000), "tokens").select("doc_id", "block", "template", "label", "overlap", "containment")


def wrapped(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Rows as those of `contained` for notices that go on over line ends; block is their first line.

    Here a block is a run of consecutive words, whatever the line ends between them, as long as the
    template's words are at CONTAINMENT of the run. Runs that reach a line which holds the template
    by itself are left to `contained`; of runs that overlap, the best one counts.
    """
    sets = as_sets(templates)
    widths = [math.ceil(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) / CONTAINMENT) for _, text in templates]
    vocabulary = sorted({w for _, tokens, _ in sets for w in tokens})
    schema = "array<struct<template:int,label:string,tokens:array<string>,need:int,width:int>>"
    table = F.from_json(F.lit(json.dumps([{"template": i, "label": x, "tokens": t, "need": n, "width": widths[i]} for i, (x, t, n) in enumerate(sets) if n])), schema)
    known = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")
    several = docs.select("doc_id", ascii_lower(text_of(docs)).alias("t")).where(F.col("t").contains("\n"))
    # a text without enough of a template's words can't hold it anywhere
    some = settle(several.select("doc_id", "t", F.array_intersect(F.split("t", NON_WORD), known).alias("v")), "v")
    some = some.select("doc_id", "t", F.explode(F.filter(table, lambda x: F.size(F.array_intersect(F.col("v"), x["tokens"])) >= x["need"])).alias("x"))
    lines = settle(some.select("doc_id", "x.*", F.transform(F.split("t", "\n"), lambda y: split_words(y, NON_WORD)).alias("lines")), "lines")
    held = F.transform("lines", lambda y: F.size(F.array_intersect(y, F.col("tokens"))) >= F.col("need"))
    at = F.flatten(F.transform("lines", lambda y, i: F.array_repeat(i, F.size(y))))
    flat = settle(lines.select("doc_id", "template", "label", "tokens", "need", "width", F.flatten("lines").alias("w"), at.alias("at"), held.alias("held")), "w", "at", "held")
    begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(F.col("tokens"), F.get(F.col("w"), i)))

    def run(i: Column) -> Column:
        overlap = F.size(F.array_intersect(F.slice(F.col("w"), i + 1, F.col("width")), F.col("tokens")))
        last = F.get(F.col("at"), F.least(i + F.col("width"), F.size("w")) - 1)
        return F.struct(i.alias("i"), F.get(F.col("at"), i).alias("block"), last.alias("last"), overlap.alias("overlap"))

    whole = lambda x: F.array_contains(F.slice(F.col("held"), x["block"] + 1, x["last"] - x["block"] + 1), True)
    runs = settle(flat.withColumn("runs", F.filter(F.transform(begins, run), lambda x: (x["overlap"] >= F.col("need")) & (x["last"] > x["block"]) & ~whole(x))), "runs")
    apart = lambda x, j: (j == 0) | (2 * (x["i"] - F.get(F.col("runs"), j - 1)["i"]) > F.col("width"))
    best = lambda x: F.array_max(F.transform(F.filter("runs", lambda y: (y["i"] >= x["i"]) & (y["i"] < x["i"] + F.col("width"))), lambda y: y["overlap"]))
    found = runs.select("doc_id", "template", "label", "tokens", F.explode(F.transform(F.filter("runs", apart), lambda x: F.struct(x["block"].alias("block"), best(x).alias("overlap")))).alias("b"))
    return found.select("doc_id", "b.block", "template", "label", "b.overlap", (F.col("b.overlap") / F.size("tokens")).alias("containment"))


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of the places where the phrase's words stand one after another."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == part)
        return hit

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document row: doc_id, n_words, the base phrases' places, labels and a score.

    score: the best containment of a template by one of the text's lines or a run of words over line ends, 1 where a base phrase
    stands, else 0. A null text counts as empty. Rows that share a doc_id share the labels of the
    templates; rows without one get theirs too.
    """
    lowered = ascii_lower(text_of(docs))
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    maybe = F.col("t").rlike("|".join(gap.join(p.split(" ")) for p in phrases))
    words = docs.select("doc_id", lowered.alias("t")).select("doc_id", split_words(F.col("t"), NON_WORD).alias("w"), maybe.alias("maybe"))
    empty = F.array().cast("array<int>")
    places = words.select("doc_id", F.size("w").cast("bigint").alias("n_words"), *[F.when(F.col("maybe"), phrase_places(F.col("w"), p)).otherwise(empty).alias(f"p{k}") for k, p in enumerate(phrases)])
    every = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    base = F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())])))
    base = places.select("doc_id", "n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"), F.sort_array(base).alias("base"))
    more = contained(docs, templates).unionByName(wrapped(docs, templates)).groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"), F.countDistinct("block").alias("n_blocks"))
    more = stage(more.withColumnRenamed("doc_id", "__doc"), "labels")
    out = base.join(small(more, more.count()), F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    labels = F.array_join(F.sort_array(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>"))))), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"),
    )
