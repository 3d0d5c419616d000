"""Helpers that the training-data operators share.

All of them build DataFrame plans; nothing here runs Python on the executors.
"""

from __future__ import annotations

import itertools
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, and the same as a class for `split`.
SPACE = r"[\x20\x09-\x0D]+"
#: ASCII characters that are neither digits nor lower-case letters.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a counted table may be broadcast.
BROADCAST_ROWS = 300_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(module: str) -> None:
    """Send the module's functions to Python workers whole, so that executors needn't have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


# ---------------------------------------------------------------- scratch tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only where it is unset in a local session, as in tests, a temporary folder is used.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        place = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Cuts the lineage (a lost executor costs no more than the step under way), lets
    Catalyst know the size, and prunes columns for later readers.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables which no later plan reads."""
    for df in tables:
        path = getattr(df, "_lattica_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows allow it; a shuffle join otherwise."""
    return F.broadcast(df) if rows <= limit else df


def settle(df: DataFrame, *names: str) -> DataFrame:
    """df, with these columns computed where they stand.

    A later filter on them isn't pushed below: there it would compute them twice, and once for
    each element where a lambda refers to them.
    """
    return df.select(*[c for c in df.columns if c not in names], F.inline_outer(F.array(F.struct(*names))))


# ---------------------------------------------------------------- text
def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII texts take the quicker function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def split_words(text: Column, separators: str) -> Column:
    return F.filter(F.split(text, separators), lambda w: w != "")


def shingle_hashes(words: Column, k: int) -> Column:
    """XXH64 of each k-word window of a non-empty word array, hashed word after word.

    An array of fewer than k words gives one hash of all of them.
    """
    n = F.size(words)
    each = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), each)).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


# ---------------------------------------------------------------- SimHash
def _ones(width: int) -> Column:
    """A 1 at the foot of every lane of `width` bits."""
    return F.lit(signed(sum(1 << at for at in range(0, 64, width))))


def _sums(hashes: Column, width: int, finish: Callable[[Column], Column] | None = None) -> Column:
    """Counts of set bits: field k holds those of the bits k, k + width, ... in lanes of `width` bits.

    One addition counts 64 / width bits. For fewer than 2**(width - 1) hashes.
    """
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"a{k}") for k in range(width)])

    def add(acc: Column, h: Column) -> Column:
        return F.struct(*[(acc[f"a{k}"] + (F.shiftrightunsigned(h, k) if k else h).bitwiseAND(_ones(width))).alias(f"a{k}") for k in range(width)])

    return F.aggregate(hashes, zero, add, finish) if finish else F.aggregate(hashes, zero, add)


def _widened(acc: Column) -> list[Column]:
    """Counts in 8 fields of 8-bit lanes as 16 columns of 16-bit lanes."""
    even = F.lit(0x00FF00FF00FF00FF)
    return [acc[f"a{k}"].bitwiseAND(even) for k in range(8)] + [F.shiftrightunsigned(acc[f"a{k}"], 8).bitwiseAND(even) for k in range(8)]


def _majority(counts: list[Column], n: Column) -> Column:
    """The bits that over half of n < 2**(width - 2) hashes have, from counts in len(counts) columns.

    An addition to all lanes raises bit width - 2 of those that count over half.
    """
    width, out = len(counts), None
    raised = (F.lit(2 ** (width - 2) - 1).cast("bigint") - F.shiftright(n, 1)) * _ones(width)
    for k, count in enumerate(counts):
        bits = F.shiftleft(F.shiftrightunsigned(count + raised, width - 2).bitwiseAND(_ones(width)), k)
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of 64-bit hashes: a bit is set if it is in over half of them.

    An empty array gives zero. Hashes are counted in lanes of 8 bits by chunks of 127; chunks are
    summed in lanes of 16 bits. Arrays too long for those are counted in lanes of 32 bits.
    """
    n, chunk = F.size(hashes), 127
    fields = lambda acc, width: [acc[f"a{k}"] for k in range(width)]
    one = _sums(hashes, 8, lambda acc: _majority(_widened(acc), n))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda i: _sums(F.slice(hashes, i * chunk + 1, chunk), 8))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"a{k}") for k in range(16)])
    merge = lambda acc, x: F.struct(*[(acc[f"a{k}"] + y).alias(f"a{k}") for k, y in enumerate(_widened(x))])
    several = F.aggregate(chunks, zero, merge, lambda acc: _majority(fields(acc, 16), n))
    many = _sums(hashes, 32, lambda acc: _majority(fields(acc, 32), n))
    return F.when(n == 0, F.lit(0).cast("bigint")).when(n <= chunk, one).when(n < 2**14, several).otherwise(many)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_masks(radius: int, nodes: int) -> list[int]:
    """Masks such that two fingerprints within the radius agree under one of them at least.

    The 64 bits are cut into m blocks. `radius` differing bits touch at most so many blocks, so
    m - radius blocks agree. m grows with the number of nodes until unrelated ones seldom meet.
    """
    m = radius + 1
    while m < 2 * radius + 4 and 64 * (m - radius) / m < max(nodes, 1).bit_length() + 2:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(blocks, m - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---------------------------------------------------------------- connected components
def _changed(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def _stars(edges: DataFrame) -> DataFrame:
    """A large star and a small star of edges (u, v) with u > v: every node moves on to its least neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (node, root), root the least node reachable.

    Alternating large and small stars (Kiveris et al. 2014) until nothing changes; every other round
    is written to the shared folder. Only nodes that have an edge are returned.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = _changed(now)
    while before[0]:
        then = stage(_stars(_stars(now)), "edges")
        after = _changed(then)
        discard(now)
        now = then
        if after == before:
            break
        before = after
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    done = stage(out, "components")
    discard(now)
    return done


def near_components(nodes: DataFrame, radius: int, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components of nodes (id, fp) whose fingerprints differ in at most `radius` bits.

    nodes: distinct ids. verify: takes candidate pairs (u, v) and keeps the true links.
    Returns (node, root) for the nodes that have a link.

    Pigeonhole blocks bring every close pair into one bucket; nodes with a column `buckets` (arrays of
    numbers) bring their own, and only pairs that share one are looked at. Dense buckets aren't expanded into
    all pairs: first each member is compared with its neighbour in order and with the bucket's
    first; what those links connect is contracted, and only buckets that still hold more than one
    component are searched for pairs across components. Pairs inside a component would add nothing,
    so the components are exact. Buckets of up to three members are complete after the first step.
    """
    if "buckets" in nodes.columns:
        keyed = nodes.select(F.explode("buckets").alias("bucket"), "fp", "id")
    else:
        masks = block_masks(radius, nodes.count())
        tables = F.array(*[F.lit(signed(m)).cast("bigint") for m in masks])
        # a bucket is a hash of its block and the block's bits, one number to sort by; should two of them meet, their pairs are compared all the same
        keyed = nodes.select("id", "fp", F.posexplode(tables).alias("t", "mask")).select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp", "id")
    bucket = Window.partitionBy("bucket")
    order = bucket.orderBy("fp", "id")
    beside = lambda f, name: F.when(hamming(F.col("fp"), f(F.col("fp")).over(order)) <= radius, f(F.col("id")).over(order)).alias(name)
    met = stage(
        keyed.select("bucket", "fp", "id", F.count("*").over(bucket).alias("size"), beside(F.lag, "prev"), beside(F.first, "head")).where("size > 1 and (size > 3 or prev is not null or head is not null)"),
        "buckets",
    )
    pairs = met.select(F.col("id").alias("u"), F.explode(F.array("prev", "head")).alias("v")).where("v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    first = components(verify(pairs) if verify else pairs)

    dense = met.where("size > 3").select("bucket", "fp", "id").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = dense.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    dense = stage(dense.join(mixed, "bucket", "left_semi"), "dense")
    a = dense.select("bucket", F.col("fp").alias("fa"), F.col("id").alias("u"), F.col("root").alias("ru"))
    b = dense.select("bucket", F.col("fp").alias("fb"), F.col("id").alias("v"), F.col("root").alias("rv"))
    across = a.join(b, "bucket").where((F.col("ru") < F.col("rv")) & (hamming(F.col("fa"), F.col("fb")) <= radius))
    if verify:
        links = verify(across.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        root = lambda c: first.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        links = links.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    else:
        links = across.select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    second = components(links.distinct())
    over = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
    found = first.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = second.join(first, "node", "left_anti").select("node", "root")
    out = stage(found.unionByName(alone), "classes")
    discard(met, dense, first, second)
    return out
