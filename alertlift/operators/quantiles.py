"""Exact quantiles per group that never gather a group in one task.

``percentile`` and ``median`` keep every distinct value of a group in one
buffer.  That is fine for minutes 0..121, but not for a continuous column when
one airport holds a third of the rows.  Here three narrow passes find the same
number:

1. a mergeable KLL sketch per group gives 65 values whose ranks lie closely
   around the quantile, equally far apart in rank, not in value;
2. exact counts in the slices between them (and below and above all) tell
   which slice holds the wanted rank;
3. only the rows of that slice are counted by value and ranked.

The sketch steers the slicing only.  Should it miss, the wanted rank lies in
the slice below or above and step 3 reads that one, so the result is exact
either way.  Heavy tails and infinities need no care: values are compared,
never subtracted, until the answer is interpolated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlift.operators.joins import attach_row, join_null_safe
from alertlift.sources.staging import stage

SKETCH_SIZE = 4096
MARGIN = 0.01
SLICES = 64
MERGE_LANES = 64

Targets = Mapping[str, tuple[str, float]]


def exact_quantiles(
    df: DataFrame,
    targets: Targets,
    by: Sequence[str] = (),
    neighbours: bool = False,
) -> DataFrame:
    """One row per group with linearly interpolated quantiles.

    ``targets`` maps an output name to ``(column, probability)``.  NULL values
    are skipped; a group without any value is absent from the result.
    ``neighbours=True`` returns the two values around each quantile, as
    ``<name>_low`` and ``<name>_high``, instead of interpolating.

    ``df`` is read three times, so hand in a scan (see ``sources.stage``) if
    it is costly to compute.
    """
    by = list(by)
    spread = range(len(targets))
    flat = df.select(
        *by,
        *[F.col(c).cast("double").alias(f"__v{i}") for i, (c, _) in enumerate(targets.values())],
    ).where(F.coalesce(*[F.col(f"__v{i}") for i in spread]).isNotNull())

    group = F.struct(*by) if by else F.lit(0)
    brackets = stage(_brackets(flat, targets, by)).withColumn("gid", group)
    joined = join_null_safe(flat, brackets, by) if by else attach_row(flat, brackets)
    sliced = joined.select(
        "gid", *[f"__v{i}" for i in spread], *[_slice(i).alias(f"__s{i}") for i in spread]
    )
    picks = stage(_picks(sliced, targets))
    ranked = _ranked(sliced, picks, len(targets))

    outputs = []
    for i, name in enumerate(targets):
        mine = F.col("target") == i
        low = F.max(F.when(mine & _holds("low_rank"), F.col("value")))
        high = F.max(F.when(mine & _holds("high_rank"), F.col("value")))
        if neighbours:
            outputs += [low.alias(f"{name}_low"), high.alias(f"{name}_high")]
            continue
        share = F.max(F.when(mine, F.col("position") - F.col("low_rank")))
        # Between equal values there is nothing to interpolate, infinite ones included.
        outputs.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    found = ranked.groupBy("gid").agg(*outputs)
    return found.select(*[F.col("gid")[c].alias(c) for c in by], *found.columns[1:])


def _brackets(flat: DataFrame, targets: Targets, by: Sequence[str]) -> DataFrame:
    """Per group and target: values around the quantile, ascending.

    Two merge levels: the sketches of one group first meet in 64 lanes.
    """
    size = F.lit(SKETCH_SIZE)
    names = [f"__v{i}" for i in range(len(targets))]
    lane = (F.spark_partition_id() % MERGE_LANES).alias("__lane")
    lanes = flat.groupBy(*by, lane).agg(
        *[F.kll_sketch_agg_double(v, size).alias(v) for v in names]
    )
    merged = lanes.groupBy(*by).agg(*[F.kll_merge_agg_double(v, size).alias(v) for v in names])
    columns = []
    for i, (_, p) in enumerate(targets.values()):
        ranks = [min(1.0, max(0.0, p + MARGIN * (2 * j / SLICES - 1))) for j in range(SLICES + 1)]
        values = F.kll_sketch_get_quantile_double(f"__v{i}", F.array(*map(F.lit, ranks)))
        known = F.kll_sketch_get_n_double(f"__v{i}") > 0
        columns.append(F.when(known, values).alias(f"__bounds{i}"))
    return merged.select(*by, *columns)


def _slice(i: int) -> Column:
    """Slice number of one target's value, never decreasing in the value.

    Only values inside the bracket, a few hundredths of all, are compared with
    every bound.
    """
    value, bounds = F.col(f"__v{i}"), F.col(f"__bounds{i}")
    reached = F.size(F.filter(bounds, lambda b: b <= value))
    return (
        F.when(value < bounds[0], F.lit(0))
        .when(value > bounds[SLICES], F.lit(SLICES + 2))
        .when(value.isNotNull(), reached)
        .cast("int")
    )


def _holds(rank: str) -> Column:
    """Whether a counted row covers a zero-based rank of its group."""
    return (F.col("below") <= F.col(rank)) & (F.col(rank) < F.col("upto"))


def _picks(sliced: DataFrame, targets: Targets) -> DataFrame:
    """The one or two slices per group and target that hold its ranks."""
    pairs = [
        F.struct(F.lit(i).alias("target"), F.col(f"__s{i}").alias("slice"))
        for i in range(len(targets))
    ]
    melted = sliced.select("gid", F.explode(F.array(*pairs)).alias("pair"))
    group = Window.partitionBy("gid", "target")
    probabilities = F.array(*[F.lit(float(p)) for _, p in targets.values()])
    return (
        melted.select("gid", "pair.*")
        .where("slice is not null")
        .groupBy("gid", "target", "slice")
        .agg(F.count("*").alias("rows"))
        .withColumns(
            {
                "n": F.sum("rows").over(group),
                "upto": F.sum("rows").over(group.orderBy("slice")),
                "p": F.element_at(probabilities, F.col("target") + 1),
            }
        )
        .withColumns(
            {
                "below": F.col("upto") - F.col("rows"),
                "position": (F.col("n") - 1) * F.col("p"),
            }
        )
        .withColumns(
            {
                "low_rank": F.floor("position").cast("bigint"),
                "high_rank": F.ceil("position").cast("bigint"),
            }
        )
        .where(_holds("low_rank") | _holds("high_rank"))
        .select("gid", "target", "slice", "below", "position", "low_rank", "high_rank")
    )


def _ranked(sliced: DataFrame, picks: DataFrame, count: int) -> DataFrame:
    """Values of the picked slices, counted, with the ranks they cover.

    Rows of other slices leave before anything is multiplied or shuffled.  A
    group has at most two picked slices per target: the least and the greatest.
    """
    bounds = []
    for i in range(count):
        mine = F.when(F.col("target") == i, F.col("slice"))
        bounds += [F.min(mine).alias(f"__a{i}"), F.max(mine).alias(f"__b{i}")]
    near = join_null_safe(sliced, picks.groupBy("gid").agg(*bounds), ["gid"])
    kept = [
        F.coalesce(F.col(f"__s{i}").isin(F.col(f"__a{i}"), F.col(f"__b{i}")), F.lit(False))
        for i in range(count)
    ]
    pairs = [
        F.when(
            kept[i],
            F.struct(
                F.lit(i).alias("target"),
                F.col(f"__s{i}").alias("slice"),
                F.col(f"__v{i}").alias("value"),
            ),
        )
        for i in range(count)
    ]
    values = (
        near.where(reduce(lambda a, b: a | b, kept))
        .select("gid", F.explode(F.array(*pairs)).alias("pair"))
        .where("pair is not null")
        .select("gid", "pair.*")
    )
    in_slice = Window.partitionBy("gid", "target", "slice").orderBy("value")
    counted = values.groupBy("gid", "target", "slice", "value").agg(F.count("*").alias("rows"))
    return (
        join_null_safe(counted, picks, ["gid", "target", "slice"])
        .withColumn("upto", F.col("below") + F.sum("rows").over(in_slice))
        .withColumn("below", F.col("upto") - F.col("rows"))
    )
