"""Connected components of a list of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Each round at least halves the longest chain, so this is beyond any graph that can be stored.
MOST_ROUNDS = 100


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links(a, b) -> (node, comp), comp the smallest node reached; nodes without links are absent.

    A large step joins every greater neighbour of a node to the smallest node it knows, a small step its smaller ones,
    and neither changes what is connected. Once every link is the only one of its greater end, and that end is no
    other link's smaller end, the links are stars and the work is done. Tables are written between rounds; nothing but
    one flag comes to the driver. Raises if ``MOST_ROUNDS`` don't suffice.
    """
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    for k in range(1, MOST_ROUNDS + 1):
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        tally = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("down"))
        if tally.where("ups > 1 OR (ups = 1 AND down = 0)").limit(1).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.save(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    raise RuntimeError(f"components: not done after {MOST_ROUNDS} rounds")
