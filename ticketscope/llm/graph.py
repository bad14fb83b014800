"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (u, v: long); root is the
    smallest node of the component.

    Large star: each node's larger neighbours move to its smallest one. Small
    star: each node and its smaller neighbours move to the smallest. Both are a
    minimum per node (combined before the shuffle) joined back to the edges, so
    a node with very many edges is split by the skew join; rounds stop when the
    edge set no longer changes, O(log^2 nodes) at most. Edges are checkpointed
    each round and only their count and checksum reach the driver.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    e = cut(edges.where("u <> v").select(big.alias("u"), small.alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        e = cut(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state, before = _state(e), state
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
