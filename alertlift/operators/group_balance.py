"""Group folds of even size: the largest group goes to the lightest fold, and so on.

Groups of one size are interchangeable, so only their number matters: filling runs over size classes, of which there are fewer
than ``sqrt(2 * rows)``, and takes a class in one step whatever the number of its groups.  Which groups of a class
make up a fold's share follows from ranks summed up over hash buckets; no task sorts all groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlift.operators.folds import DIGEST_DIGITS, FOLDS
from alertlift.operators.joins import join_null_safe


def fill(loads: Sequence[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` rows each fold gets, always one to the lightest (ties: the first).

    That picks the ``count`` smallest of the loads ``l, l + size, l + 2 * size, ...`` of all folds, found by halving.
    """
    below = lambda level: [max(0, -(-(level - l) // size)) for l in loads]
    low, high = min(loads), min(loads) + size * count + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    given = below(low)
    rest = count - sum(given)
    for i, load in enumerate(loads):
        if rest and load + given[i] * size == low:
            given[i] += 1
            rest -= 1
    return given


def shares(classes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[int]]]:
    """Per size class, in falling order, the rank at which each fold's share ends."""
    loads, out = [0] * k, []
    for size, count in sorted(classes, reverse=True):
        given = fill(loads, size, count)
        loads = [l + g * size for l, g in zip(loads, given, strict=True)]
        out.append((size, [sum(given[: i + 1]) for i in range(k)]))
    return out


def balanced_group_folds(df: DataFrame, group: str, k: int = FOLDS, name: str = "fold") -> DataFrame:
    """Group, its size and its fold.  A missing group is one group."""
    digest = F.md5(F.coalesce(F.col(group).cast("string"), F.lit("")))
    sizes = (
        df.groupBy(group)
        .agg(F.count("*").alias("size"))
        .withColumn("bucket", F.substring(digest, 1, DIGEST_DIGITS))
    )
    buckets = sizes.groupBy("size", "bucket").agg(F.count("*").alias("groups"))
    classes = [(r[0], r[1]) for r in buckets.groupBy("size").agg(F.sum("groups")).collect()]
    ends = df.sparkSession.createDataFrame(shares(classes, k), "size long, ends array<long>")
    in_class = Window.partitionBy("size").orderBy("bucket")
    offsets = buckets.select("size", "bucket", (F.sum("groups").over(in_class) - F.col("groups")).alias("before"))
    in_bucket = Window.partitionBy("size", "bucket").orderBy(group)
    rank = F.col("before") + F.col("in_bucket") - 1
    # Bounded by sqrt(2 * rows) classes: broadcast, since one class may hold most groups.
    return (
        sizes.withColumn("in_bucket", F.row_number().over(in_bucket))
        .join(offsets, ["size", "bucket"])
        .withColumn("rank", rank)
        .join(F.broadcast(ends), "size")
        .select(group, "size", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias(name))
    )


def assign_balanced_group_folds(df: DataFrame, group: str, k: int = FOLDS, name: str = "fold") -> DataFrame:
    """All rows of a group share a fold, and folds are as even as greedy filling makes them."""
    return join_null_safe(df, balanced_group_folds(df, group, k, name).select(group, name), [group])
