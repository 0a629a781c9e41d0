"""Fold columns for out-of-fold evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlift.functions.scalar import hash_bucket, settle
from alertlift.operators.joins import join_null_safe

SEED = 42
FOLDS = 3
DIGEST_DIGITS = 4


def assign_folds(
    df: DataFrame, key: str = "alert_id", k: int = FOLDS, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Shuffled k-fold: the fold follows from key and seed alone, so there is
    no shuffle and a repartitioned table gets the same folds.

    A row without a key would belong to no fold and vanish; it is an error.
    """
    known = F.coalesce(F.col(key), F.raise_error(F.lit(f"{key} is NULL: the row would get no fold")))
    return df.withColumn(name, hash_bucket(known, k, seed))


def group_folds(df: DataFrame, group: str, k: int = FOLDS, name: str = "fold") -> DataFrame:
    """Group, its size and its fold: groups dealt round robin by size.

    The rank runs over all groups, of which there may be as many as alerts, so
    it is summed up from three levels instead of sorted in one task: size
    classes (fewer than sqrt(2 * rows) of them), hash buckets of one class
    (65,536 at most), groups of one bucket.
    """
    digest = F.md5(F.coalesce(F.col(group).cast("string"), F.lit("")))
    sizes = (
        df.groupBy(group)
        .agg(F.count("*").alias("size"))
        .withColumn("bucket", F.substring(digest, 1, DIGEST_DIGITS))
    )
    buckets = sizes.groupBy("size", "bucket").agg(F.count("*").alias("groups"))
    by_size = Window.orderBy(F.desc("size"))
    classes = (
        buckets.groupBy("size")
        .agg(F.sum("groups").alias("groups"))
        .select("size", (F.sum("groups").over(by_size) - F.col("groups")).alias("ahead"))
    )
    in_class = Window.partitionBy("size").orderBy("bucket")
    offsets = (
        buckets.withColumn("before", F.sum("groups").over(in_class) - F.col("groups"))
        .join(classes, "size")
        .select("size", "bucket", (F.col("ahead") + F.col("before")).alias("offset"))
    )
    in_bucket = Window.partitionBy("size", "bucket").orderBy(group)
    rank = F.col("offset") + F.col("in_bucket") - 1
    return (
        sizes.withColumn("in_bucket", F.row_number().over(in_bucket))
        .join(offsets, ["size", "bucket"])
        .select(group, "size", (rank % k).cast("int").alias(name))
    )


def assign_group_folds(
    df: DataFrame, group: str, k: int = FOLDS, name: str = "fold"
) -> DataFrame:
    """All rows of a group share a fold; a missing group is one group."""
    folds = group_folds(df, group, k, name).select(group, name)
    return join_null_safe(df, folds, [group])


def fit_lines(
    df: DataFrame, models: Mapping[str, str], y: str = "label", k: int = FOLDS
) -> dict[str, list[tuple[float, float]]]:
    """Per model and held-out fold, base and slope of the line through all
    other folds.

    One pass gathers the moments of each fold; a training set is the sum of
    the k - 1 folds outside.  Only k rows come back.  The centred moments are
    merged around the means, so no precision is lost.
    """
    value = F.col(y).cast("double")
    moments = []
    for m, x in enumerate(models.values()):
        feature = F.when(value.isNotNull(), F.col(x).cast("double"))
        target = F.when(F.col(x).isNotNull(), value)
        moments += [
            F.count(feature).alias(f"n_{m}"),
            F.avg(feature).alias(f"x_{m}"),
            F.avg(target).alias(f"y_{m}"),
            F.var_pop(feature).alias(f"xx_{m}"),
            F.covar_pop(feature, target).alias(f"xy_{m}"),
        ]
    rows = df.groupBy("fold").agg(*moments).limit(k + 1).collect()
    if len(rows) > k or any(r["fold"] not in range(k) for r in rows):
        raise ValueError(f"fold must lie in 0..{k - 1}")

    lines = {}
    for m, name in enumerate(models):
        lines[name] = []
        for i in range(k):
            parts = [r for r in rows if r["fold"] != i and r[f"n_{m}"]]
            n = sum(r[f"n_{m}"] for r in parts)
            if not n:
                raise ValueError(f"no training rows outside fold {i}")
            mean_x = sum(r[f"n_{m}"] * r[f"x_{m}"] for r in parts) / n
            mean_y = sum(r[f"n_{m}"] * r[f"y_{m}"] for r in parts) / n
            xx = xy = 0.0
            for r in parts:
                dx, dy = r[f"x_{m}"] - mean_x, r[f"y_{m}"] - mean_y
                xx += r[f"n_{m}"] * (r[f"xx_{m}"] + dx * dx)
                xy += r[f"n_{m}"] * (r[f"xy_{m}"] + dx * dy)
            # A constant feature explains nothing: predict the mean.
            slope = xy / xx if xx > 0 else 0.0
            lines[name].append((mean_y - slope * mean_x, slope))
    return lines


def oof_lines(
    df: DataFrame,
    models: Mapping[str, str],
    y: str = "label",
    keep: Sequence[str] = ("alert_id", "airport"),
    k: int = FOLDS,
) -> DataFrame:
    """Out-of-fold least squares on one feature per model, long by model.

    ``models`` maps a model name to its feature; ``df`` carries ``fold`` and is
    read by the fit and again by whoever reads the result, so it should be a
    scan.  Fold i is predicted by the line through all other folds; the lines
    are constants of the projection.  Predictions are rounded to 9 decimals.
    """
    lines = fit_lines(df, models, y, k)
    held_out = F.col("fold") + 1
    scored = []
    for name, x in models.items():
        base = F.element_at(F.array(*[F.lit(b) for b, _ in lines[name]]), held_out)
        slope = F.element_at(F.array(*[F.lit(s) for _, s in lines[name]]), held_out)
        pred = settle(base + slope * F.col(x))
        scored.append(F.struct(F.lit(name).alias("model"), pred.alias("duration_pred")))
    rows = df.select(
        *keep,
        "fold",
        F.col(y).cast("double").alias("duration_true"),
        (scored[0] if len(scored) == 1 else F.explode(F.array(*scored))).alias("__m"),
    )
    return rows.select(*keep, "__m.model", "fold", "duration_true", "__m.duration_pred")
