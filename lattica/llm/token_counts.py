"""Operator 6: token counts by source, language and tokenizer version, kept up to date by deltas.

A store is a folder with one sub-folder per attempt at a batch. It holds signed document counts
(the ledger) and the signed totals they add up to. Totals are additive, so the current rollup is the
sum over the committed batches; a batch is committed by one marker file that names the attempt, and
committing a batch again changes nothing.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, ship, stage

ship(__name__)

#: The vocabulary file and its version's name; both are parameters of every function.
VOCABULARY, VERSION = "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_50k@1"
#: How a text is cut before its bytes are merged: a fixed value that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LEDGER = "doc_id bigint, source string, lang string, tokenizer_version string, sign int, n_tokens bigint"
TOTALS = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"


def _counter(lines: bytes):
    made = {}

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "encoding" not in made:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
            made["encoding"] = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = made["encoding"].encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, source, lang, text) with n_tokens; a null or empty text has none.

    The driver reads the vocabulary (under 1 MB) and ships it with the function.
    """
    with open(vocabulary, "rb") as f:
        lines = f.read()
    count = F.pandas_udf(_counter(lines), "bigint")
    return docs.select("doc_id", "source", "lang", count("text").alias("n_tokens"))


class Store:
    """Delta-maintained rollups in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[str]:
        """The committed batches; a batch that was broken off isn't among them."""
        system, p = self._path("commits")
        return sorted(x.getPath().getName() for x in system.listStatus(p)) if system.exists(p) else []

    def _attempt(self, batch: str) -> str:
        """The folder of the attempt that a batch's marker names."""
        system, p = self._path(f"commits/{batch}")
        file = system.open(p)
        try:
            return file.readUTF()
        finally:
            file.close()

    def _read(self, kind: str, schema: str) -> DataFrame:
        attempts = [self._attempt(n) for n in self.batches()]
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{kind}/{n}" for n in attempts]) if attempts else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """The counted documents that are in force: rows whose signs don't cancel."""
        keys = ["doc_id", "source", "lang", "tokenizer_version", "n_tokens"]
        return self._read("ledger", LEDGER).groupBy(*keys).agg(F.sum("sign").alias("rows")).where("rows > 0")

    def totals(self) -> DataFrame:
        """Rows (source, lang, tokenizer_version, n_docs, n_tokens), without groups that are empty."""
        sums = self._read("totals", TOTALS).groupBy("source", "lang", "tokenizer_version").agg(F.sum("n_docs").cast("bigint").alias("n_docs"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add signed rows (LEDGER) as a batch; False if that batch is committed already.

        Ledger and totals are written whole, into folders of this attempt, before the marker; of two
        writers of one batch, one makes the marker and the other's folders are never read.
        """
        system, marker = self._path(f"commits/{batch}")
        if system.exists(marker):
            return False
        attempt = f"{batch}-{uuid.uuid4().hex}"
        signed.write.parquet(f"{self.folder}/ledger/{attempt}")
        rows = self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger/{attempt}")
        totals = rows.groupBy("source", "lang", "tokenizer_version").agg(F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        totals.write.parquet(f"{self.folder}/totals/{attempt}")
        # the marker appears whole under its name or not at all
        _, draft = self._path(f"drafts/{attempt}")
        file = system.create(draft, False)
        file.writeUTF(attempt)
        file.close()
        system.mkdirs(marker.getParent())
        return not system.exists(marker) and system.rename(draft, marker)

    def insert(self, batch: str, docs: DataFrame, version: str = VERSION, vocabulary: str = VOCABULARY) -> bool:
        """Count new documents (doc_id, source, lang, text)."""
        return self.commit(batch, self._signed(count_tokens(docs, vocabulary), version, 1))

    def delete(self, batch: str, ids: DataFrame, version: str | None = None) -> bool:
        """Take the documents with these doc_ids out, for one tokenizer version or for all.

        A null doc_id stands for all documents without one.
        """
        old = self._with(self.ledger(), ids)
        return self.commit(batch, self._reversed(old if version is None else old.where(F.col("tokenizer_version") == version)))

    def revise(self, batch: str, docs: DataFrame, version: str = VERSION, vocabulary: str = VOCABULARY) -> bool:
        """Replace the version's counts of these documents by those of their new texts.

        A null doc_id stands for all documents without one.
        """
        old = self._with(self.ledger().where(F.col("tokenizer_version") == version), docs)
        return self.commit(batch, self._reversed(old).unionByName(self._signed(count_tokens(docs, vocabulary), version, 1)))

    @staticmethod
    def _with(rows: DataFrame, ids: DataFrame) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias("__id")).distinct()
        return rows.join(ids, rows["doc_id"].eqNullSafe(ids["__id"]), "left_semi")

    @staticmethod
    def _signed(counted: DataFrame, version: str, sign: int) -> DataFrame:
        return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(sign).alias("sign"), "n_tokens")

    @staticmethod
    def _reversed(old: DataFrame) -> DataFrame:
        return old.select("doc_id", "source", "lang", "tokenizer_version", (-F.col("rows")).cast("int").alias("sign"), "n_tokens")


def rollup(docs: DataFrame, version: str = VERSION, vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals of docs after a history of batches in a new store.

    The documents arrive in two batches by the hash of their id; of each eighth document the first
    batch has an outdated count, as of an empty text, which a later batch revises; another eighth is
    deleted and inserted again. A batch is committed twice on the way. The totals are those of docs.
    Null sources and languages are groups of their own; repeated rows count each.

    The texts are counted once, and all batches take their signed rows from these counts.
    """
    store = Store(docs.sparkSession, new_path(docs.sparkSession, "counts"))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(8))
    counted = stage(store._signed(count_tokens(docs, vocabulary), version, 1).withColumn("part", F.coalesce(part, F.lit(0))), "counted")
    columns = [c for c in counted.columns if c != "part"]
    rows = lambda where: counted.where(where).select(*columns)
    outdated = rows("part = 1").withColumn("n_tokens", F.lit(0).cast("bigint"))
    store.commit("1-first", rows("part in (2, 4, 6, 0)").unionByName(outdated))
    store.commit("2-second", rows("part in (3, 5, 7)"))
    store.delete("3-delete", rows("part = 2"), version)
    store.commit("2-second", rows("part in (3, 5, 7)"))
    store.commit("4-revise", store._reversed(store._with(store.ledger(), outdated)).unionByName(rows("part = 1")))
    store.commit("5-again", rows("part = 2"))
    return store.totals()
