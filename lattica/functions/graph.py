"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its larger (large) or its smaller neighbours on to the least node that it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of the nodes of edges (u, v): the least node that each can reach.

    Large and small stars in turn (Kiveris et al. 2014) until the edges stay as they are. Each round is written
    to the shared folder, so that a lost executor costs one round.
    """
    now = Kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, then = state, Kept(_star(_star(now.df, True), False), "edges")
        now.drop()
        now = then
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
