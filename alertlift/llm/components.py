"""Connected components of a distributed edge list by alternating star contraction.

Large-star links a node's larger neighbours to its smallest neighbour, small-star the smaller ones; both are a
minimum per node (summed up before the shuffle) and a join, so a node with very many neighbours is no hot group:
adaptive execution splits the edge side of that join.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlift.sources.staging import keep_staged, stage, staged_scope


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """All edges already point from the larger node ``u`` to the smaller node ``v``."""
    least = _least(edges)
    pairs = edges.join(least, "u")
    return (
        pairs.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) of every node with an edge; component_id is the smallest node reachable.

    ``edges``: two columns of one ordered type, either direction, repeats and loops allowed, no nulls.
    """
    a, b = edges.columns
    with staged_scope(edges.sparkSession):
        now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
        state = None
        while True:
            now = stage(_small_star(_large_star(now)))
            seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if seen == state:
                break
            state = seen
        now = keep_staged(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(roots)
