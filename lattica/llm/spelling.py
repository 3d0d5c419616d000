"""Operator 11: spelling variants, found by halves of words in Aho-Corasick automata.

Words that differ by one inserted, deleted or replaced character agree in one half of either of them:
what was edited lies in the other. So every word gives two segments, its first and its second half;
automata hold the segments of a shard of the words, all words are scanned by them, and a segment that
is met counts where it stands at the word's start (first halves) or end (second halves) and the lengths
differ by one at most. Only such words are verified.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, small, stage

ship(__name__)

#: Code points and occurrences that a word has at least.
LENGTH, OCCURRENCES = 7, 2
#: A deletion falls on one in so many of a document's words.
DELETED = 31
#: A form occurs at least so many times as often as the word.
FORM = 10
#: Words in an automaton, and words that a task's cell scans, at most about.
SHARD, SCANNED = 20_000, 100_000
#: Counted words that a task holds before it passes them on.
HELD = 300_000


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (word, n) of documents (doc_id, text); a word may come in several rows."""
    import zlib

    # in Latin-1 each letter of the alphabet is a byte; what isn't in the alphabet becomes a space
    letters = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
    held: Counter = Counter()
    passed = lambda: pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})
    for pdf in batches:
        for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
            if not text:
                continue
            of_doc = zlib.crc32(f"{doc}:".encode())
            for run, n in Counter([w for w in text.encode("latin-1", "replace").translate(letters).split() if len(w) >= LENGTH]).items():
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), of_doc)
                if h % DELETED:
                    held[run] += n
                elif len(run) > LENGTH:
                    at = h % len(run)
                    held[run[:at] + run[at + 1 :]] += n
            if len(held) > HELD:
                yield passed()
                held.clear()
    if held:
        yield passed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """Rows (word, n) of the words of documents (doc_id, text) with LENGTH code points and OCCURRENCES.

    Runs of [A-Za-z\\u00C0-\\u00FF] in whole texts, A-Z lower-cased; from one in DELETED runs of a document, by the
    CRC-32 of `<doc_id>:<run>`, a code point is deleted. A null text has no runs; a null doc_id is
    an empty string. Repeated rows count each time.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    return texts.mapInPandas(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class _Segment:
    """The words of a shard that share a segment, by what remains of them.

    Which of them differ from a given remainder by one edit is looked up among remainders with one
    character left out, so that a segment of many words costs no pairs but those that are near.
    """

    def __init__(self):
        self.whole: dict[str, tuple[int, str]] = {}
        self.tables: tuple[dict, dict] | None = None

    def _indexed(self) -> tuple[dict, dict]:
        if self.tables is None:
            replaced, deleted = defaultdict(list), defaultdict(list)
            for rest, entry in self.whole.items():
                for i in range(len(rest)):
                    replaced[i, rest[:i] + rest[i + 1 :]].append(entry)
                for short in {rest[:i] + rest[i + 1 :] for i in range(len(rest))}:
                    deleted[short].append(entry)
            self.tables = replaced, deleted
        return self.tables

    def near(self, rest: str, longer: int, word: str) -> list[tuple[int, str]]:
        """The (n, word) one edit from `rest`; longer: code points that they have more than the word."""
        if len(self.whole) == 1:
            entry = next(iter(self.whole.values()))
            return [entry] if one_edit(entry[1], word) else []
        if longer == 0:
            replaced = self._indexed()[0]
            return [e for i in range(len(rest)) for e in replaced.get((i, rest[:i] + rest[i + 1 :]), ()) if e[1] != word]
        if longer == 1:
            return self._indexed()[1].get(rest, [])
        return [self.whole[s] for s in {rest[:i] + rest[i + 1 :] for i in range(len(rest))} if s in self.whole]


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return short[i + (len(short) == len(long)) :] == long[i + 1 :]


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial results (word, n_near, form_n, form) of cells, whose indexed words come before those to scan."""
    import ahocorasick

    cell, automaton, segments, second, length = None, None, {}, False, 0
    for pdf in batches:
        out = []
        for key, scan, word, n in zip(pdf["cell"], pdf["scan"], pdf["word"], pdf["n"], strict=True):
            if key != cell:
                cell, automaton, segments = key, None, {}
                side, length = key.split("|", 2)[:2]
                second, length = side == "1", int(length)
                half = length // 2
            if not scan:
                segment, rest = (word[half:], word[:half]) if second else (word[:half], word[half:])
                if segment not in segments:
                    segments[segment] = _Segment()
                segments[segment].whole[rest] = (n, word)
                continue
            if not segments:  # a part of a shard to which no word was dealt
                continue
            if automaton is None:
                automaton = ahocorasick.Automaton()
                for segment, words in segments.items():
                    automaton.add_word(segment, words)
                automaton.make_automaton()
            # the only place where a segment of this cell is compatible with the word
            end = len(word) - 1 if second else half - 1
            for at, words in automaton.iter(word):
                if at != end:
                    continue
                cut = len(word) - (length - half)
                near = words.near(word[:cut] if second else word[half:], length - len(word), word)
                if second:  # words whose first half stands at this one's start are found there
                    near = [e for e in near if not word.startswith(e[1][:half])]
                if near:
                    best = min((-m, w) for m, w in near)
                    out.append((word, len(near), -best[0], best[1]))
        if out:
            yield pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, n_near, form_n, form) of the words (word, n; words distinct) that have a near word.

    n_near: the words that differ by exactly one edit; form: the one of them with the largest n, the
    smallest in code-point order of several.

    A shard holds the segments of one side, of words of one length that share their first (or last) two
    code points; a word is scanned by the shards of its own length and its neighbours', on either side. Shards
    with more than SHARD words are cut into parts, and the words that they scan into blocks, so that
    a task's cell is bounded. Near pairs are never emitted: each cell sums them up by word.
    """
    spark = words.sparkSession
    side = lambda s: F.struct(F.lit(s).alias("side"), (F.substring("word", 1, 2) if s == 0 else F.substring("word", -2, 2)).alias("edge"))
    each = words.select("word", "n", F.length("word").alias("length"), F.explode(F.array(side(0), side(1))).alias("s")).select("word", "n", "length", "s.side", "s.edge")
    held = stage(each.groupBy("side", "edge", "length").agg(F.count("*").alias("held")), "shards")
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    met = held.select("side", "edge", F.explode(F.transform(steps, lambda d: F.col("length") + d)).alias("length"), "held").groupBy("side", "edge", "length").agg(F.sum("held").alias("met"))
    shards = held.join(met, ["side", "edge", "length"])
    shards = stage(shards.select("side", "edge", F.col("length").alias("of"), F.ceil(F.col("held") / SHARD).alias("parts"), F.ceil(F.col("met") / SCANNED).alias("blocks")), "cells")
    n = shards.count()
    dealt = lambda df: df.join(small(shards, n), ["side", "edge", "of"])
    place = lambda count, seed: F.pmod(F.xxhash64("word", F.lit(seed)), F.col(count))
    upto = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    indexed = dealt(each.withColumnRenamed("length", "of")).select("side", "of", "edge", place("parts", 1).alias("part"), upto("blocks").alias("block"), F.lit(0).alias("scan"), "word", "n")
    scanned = dealt(each.select("word", "n", "side", "edge", F.explode(F.transform(steps, lambda d: F.col("length") + d)).alias("of")))
    scanned = scanned.select("side", "of", "edge", upto("parts").alias("part"), place("blocks", 2).alias("block"), F.lit(1).alias("scan"), "word", "n")
    cells = indexed.unionByName(scanned).select(F.concat_ws("|", "side", "of", "part", "block", "edge").alias("cell"), "scan", "word", "n")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words.count() // SHARD)
    partial = cells.repartition(tasks, "cell").sortWithinPartitions("cell", "scan").mapInPandas(_scanned, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    found = partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    out = stage(found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form")), "near")
    discard(held, shards)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of forms (word, form): where the forms lead, which must not go in circles.

    Each round follows twice as many forms; FORM bounds the chains by the logarithm of the largest n.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        then = stage(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        discard(now)
        now = then.select("word", "root")
        now._lattica_path = then._lattica_path
        if then.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of the vocabulary.

    form: the near word with the largest n, if that is FORM times the word's n or more; root: the last
    form that forms lead to, the word itself if it has none. An empty table gives no rows. Columns
    besides doc_id and text are ignored.
    """
    words = stage(vocabulary(docs), "words")
    near = near_words(words)
    joined = words.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("form_n") >= FORM * F.col("n"), F.lit(False)))
    judged = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("is_form"), F.col(c)).alias(c) for c in ("form", "form_n")]), "judged")
    discard(words, near)
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
