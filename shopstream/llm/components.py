"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): ``m`` the least neighbour of ``u``; aggregated before the join, which splits hot nodes."""
    least = pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).drop("w")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node) of every node of an edge; loops and repeated edges don't matter.

    Each round is a few shuffles of the edge table, which shrinks to stars; every round is written to
    the checkpoint folder.  No node's neighbours are ever gathered in one place.
    """
    e = settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    seen = _print(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _nearest(large)                                  # here u > v always
        e = settled(small.select("u", F.col("m").alias("v"))
                    .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")).distinct())
        now = _print(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
