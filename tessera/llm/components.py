"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every node hands its smallest neighbour to its larger ones. Small: to its smaller ones and itself."""
    if large:
        pairs = edges.union(edges.select("v", "u"))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, F.col("u") == F.col("k"))
    if large:
        made = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return made.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of the edges (u long, v long) with the smallest node reachable from it.

    Every round is a written table, so a lost executor repeats one round at most. Hubs are joined to one row each,
    which adaptive execution splits. Edges with a null end and loops are no edges.
    """
    now = common.written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        seen, before = state, now
        now = common.written(_star(_star(now, large=True), large=False), "edges")
        common.discard(before)
