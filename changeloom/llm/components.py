"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import materialize


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "component") % 1_000_003), F.sum(F.xxhash64("component", "node") % 999_983)).first()
    return tuple(row)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Label every node of an edge list with the smallest id that it reaches.

    Returns ``node, component`` for the nodes that have an edge to another node; self
    loops and repeated edges have no effect, null ends are ignored, and an empty list
    gives an empty table. Each round shuffles the edges twice by a node; minima are
    combined before the shuffle, and a node with very many edges is only ever the large
    side of a join, which adaptive execution splits. Rounds grow with the logarithm of
    the longest chain. Every round is written to the shared folder.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    stars = materialize(edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("component")).where("node is not null and component is not null and node <> component").distinct())
    before = _checksum(stars)
    while before[0]:
        both = stars.select(F.col("node").alias("u"), F.col("component").alias("v")).union(stars.select(F.col("component").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("low").alias("component")).where("node <> component").distinct()
        low = large.groupBy("node").agg(F.min("component").alias("low"))
        small = large.join(low, "node").select(F.when(F.col("component") == F.col("low"), F.col("node")).otherwise(F.col("component")).alias("node"), F.col("low").alias("component"))
        stars = materialize(small.where("node <> component").distinct())
        after = _checksum(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots)
