"""Operator 10: toxicity by a factorization machine over hashed terms.

A document is the set of its terms' buckets: words, and the first and last five letters of longer
words. The model (Rendle 2010) adds to a linear weight per bucket the products of latent vectors of
every pair of buckets, so that it learns which terms are toxic together. It is trained on a bounded
sample of labelled documents and scores all documents in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

#: Buckets (a power of two) and latent factors.
BUCKETS, FACTORS = 1 << 18, 8
#: Labelled documents that training uses at most; passes over them and steps, at least; rows of a step.
SAMPLE, PASSES, STEPS, STEP = 9_000, 6, 600, 100
#: Buckets that take part: in MIN_DOCS documents of the sample, and either more often toxic than chance
#: allows (deviations of a binomial), or among the most common ones, or in a pair (see `paired`).
MIN_DOCS, DEVIATIONS, COMMON = 3, 5.0, 50
#: Pairs of buckets that are toxic only together: least share of the toxic documents that a first model
#: doesn't recognise, and deviations of the labels from what that model expects.
PAIR_SHARE, PAIR_DEVIATIONS = 0.05, 6.0
#: Rates and penalties of weights and of factors, and the factors' first deviation; that of the buckets of
#: pairs is larger, for their products must grow from few documents.
RATES, PENALTIES, SPREAD, PAIR_SPREAD = (0.1, 0.05), (1e-3, 1e-2), 0.02, 1.0
#: Score from which a document is predicted toxic.
CUT = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def buckets_of(word: str) -> tuple[int, ...]:
    hashed = lambda s: zlib.crc32(s.encode("utf-8")) & (BUCKETS - 1)
    return (hashed(word),) if len(word) < 6 else (hashed(word), hashed(f"^{word[:5]}"), hashed(f"{word[-5:]}$"))


class Terms:
    """Texts to sorted arrays of distinct buckets; keeps the buckets of recent words."""

    def __init__(self, most: int = 200_000):
        self.known, self.most = {}, most

    def __call__(self, text: str | None) -> np.ndarray:
        out: set[int] = set()
        for word in set(_WORD.findall((text or "").lower())):
            found = self.known.get(word)
            if found is None:
                if len(self.known) >= self.most:
                    self.known.clear()
                found = self.known[word] = buckets_of(word)
            out.update(found)
        return np.fromiter(sorted(out), dtype=np.int32, count=len(out))


@dataclass
class Machine:
    """bias + sum w + sum over pairs of <v, v'>, as a logit."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.bias, dtype=np.float64)
        some = sizes > 0
        if some.any():
            at = np.concatenate(rows)
            begin = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            v = self.v[at]
            s = np.add.reduceat(v, begin, axis=0)
            out[some] += np.add.reduceat(self.w[at], begin) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), begin))
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))


def chosen(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which buckets take part. Rare terms of single documents would only be learnt by heart."""
    share, n, toxic = labels.mean(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for row, label in zip(rows, labels, strict=True):  # a row has each of its buckets once
        n[row] += 1
        if label:
            toxic[row] += 1
    far = (toxic - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9)) >= DEVIATIONS
    far[np.argsort(-n, kind="stable")[:COMMON]] = True
    return far & (n >= MIN_DOCS)


def paired(rows: list[np.ndarray], labels: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Which buckets belong to a pair that is toxic together beyond what was expected of its documents.

    Such a pair stands in toxic documents that were not expected to be so. Both its buckets are thus in
    PAIR_SHARE of those, which few buckets are; the documents with both are then counted by one
    product of matrices over all rows.
    """
    out = np.zeros(BUCKETS, dtype=bool)
    missed = np.flatnonzero((labels > 0) & (expected < 0.5))
    if len(missed) < MIN_DOCS:
        return out
    n = np.bincount(np.concatenate([rows[i] for i in missed]), minlength=BUCKETS)
    some = np.flatnonzero(n >= max(MIN_DOCS, PAIR_SHARE * len(missed)))
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[some] = np.arange(len(some))
    x = np.zeros((len(rows), len(some)), dtype=np.float32)
    for i, row in enumerate(rows):
        at = place[row]
        x[i, at[at >= 0]] = 1
    above = x.T @ (x * (labels - expected).astype(np.float32)[:, None])
    spread = x.T @ (x * (expected * (1 - expected)).astype(np.float32)[:, None])
    both = x[missed].T @ x[missed] >= max(MIN_DOCS, PAIR_SHARE * len(missed))
    far = both & (above >= PAIR_DEVIATIONS * np.sqrt(np.maximum(spread, 1e-9)))
    # what one bucket explains needs no pair: the two together must exceed either alone
    alone = np.diag(above) / np.sqrt(np.maximum(np.diag(spread), 1e-9))
    far &= above > np.sqrt(np.maximum(spread, 1e-9)) * (np.maximum(alone[:, None], alone[None, :]) + 1)
    out[some[far.any(axis=1)]] = True
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Train on the chosen buckets, then again with those of pairs that the first model doesn't know.

    Without labelled rows of both kinds the model is the share of toxic ones.
    """
    if not len(labels) or labels.min() == labels.max():
        return _descend(rows, labels, np.zeros(BUCKETS, dtype=bool), seed)
    part = chosen(rows, labels)
    first = _descend(rows, labels, part, seed)
    more = paired(rows, labels, first.scores([r[part[r]] for r in rows]))
    return _descend(rows, labels, part | more, seed, more) if more.any() else first


def _descend(rows: list[np.ndarray], labels: np.ndarray, part: np.ndarray, seed: int, pairs: np.ndarray | None = None) -> Machine:
    """AdaGrad on the log loss over the buckets that take part, in a seeded order."""
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    w = np.zeros(BUCKETS, dtype=np.float32)
    v = np.zeros((BUCKETS, FACTORS), dtype=np.float32)
    if not 0 < share < 1:
        return Machine(bias, w, v)
    random = np.random.default_rng(seed)
    rows = [r[part[r]] for r in rows]
    v[part] = random.normal(0, SPREAD, (int(part.sum()), FACTORS))
    if pairs is not None:
        v[pairs] *= PAIR_SPREAD / SPREAD
    gw, gv, gb = np.full(BUCKETS, 1e-6, np.float32), np.full((BUCKETS, FACTORS), 1e-6, np.float32), 1e-6
    sizes = np.array([len(r) for r in rows])
    for _ in range(max(PASSES, -(-STEPS // -(-len(rows) // STEP)))):
        order = random.permutation(len(rows))
        for k in range(0, len(order), STEP):
            batch = order[k : k + STEP]
            empty = batch[sizes[batch] == 0]
            batch = batch[sizes[batch] > 0]
            own = 1 / (1 + np.exp(-bias))
            pull_b = float((own - labels[empty]).sum())
            if len(batch):
                at, n = np.concatenate([rows[i] for i in batch]), sizes[batch]
                begin = np.concatenate(([0], np.cumsum(n)[:-1]))
                vv = v[at]
                s = np.add.reduceat(vv, begin, axis=0)
                logit = bias + np.add.reduceat(w[at], begin) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vv * vv).sum(1), begin))
                err = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]
                pull_b += float(err.sum())
                each = np.repeat(err / STEP, n).astype(np.float32)
                touched, place = np.unique(at, return_inverse=True)
                dw = np.bincount(place, each, len(touched)).astype(np.float32) + PENALTIES[0] * w[touched]
                pull = each[:, None] * (np.repeat(s, n, axis=0) - vv)
                dv = np.stack([np.bincount(place, pull[:, f], len(touched)) for f in range(FACTORS)], 1).astype(np.float32) + PENALTIES[1] * v[touched]
                gw[touched] += dw * dw
                gv[touched] += dv * dv
                w[touched] -= RATES[0] * dw / np.sqrt(gw[touched])
                v[touched] -= RATES[1] * dv / np.sqrt(gv[touched])
            gb += (pull_b / STEP) ** 2
            bias -= RATES[0] * pull_b / STEP / gb**0.5
    return Machine(bias, w, v)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most `sample` labelled documents that aren't held out.

    The sample is that of the least hashes of doc_id; its hashed terms, not its texts, come to the
    driver. A document labelled more than once is toxic if one label says so.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    terms = F.pandas_udf(_hash_terms, "array<int>")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "toxic", terms("text").alias("terms"))
    got = rows.toArrow().sort_by("doc_id")  # bounded by `sample`
    terms = got["terms"].combine_chunks() if got.num_rows else None
    each = [] if terms is None else np.split(terms.flatten().to_numpy(), terms.offsets.to_numpy()[1:-1] - terms.offsets[0].as_py())
    return fit(each, got["toxic"].to_numpy().astype(np.float64))


def _hash_terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    terms = Terms()
    for texts in batches:
        yield texts.map(terms)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    A null or empty text has the score of a document without terms. The model's size is fixed
    (BUCKETS * (FACTORS + 1) numbers) and it is broadcast once.
    """
    model = train(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, machine = Terms(), Machine(*shared.value)
        for texts in batches:
            yield pd.Series([float(x) for at in range(0, len(texts), 256) for x in machine.scores([terms(t) for t in texts.iloc[at : at + 256]])], dtype="float64")

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.pandas_udf(judge, "double")("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
