"""Attaching small statistics to a large table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put a global aggregate on every row.

    ``one_row`` must be an aggregate without grouping, hence one row by
    construction; the hint keeps Spark from planning a Cartesian product.
    """
    return df.crossJoin(F.broadcast(one_row))


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where NULL equals NULL.

    Spark broadcasts ``stats`` if its own byte statistics allow it, also when
    they are known only at run time, and splits skewed partitions otherwise.
    """
    return join_null_safe(df, stats, keys)


def join_null_safe(
    df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL, keeping the left key columns."""
    renamed = other.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    )
    return df.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def with_scopes(df: DataFrame, group: str) -> DataFrame:
    """Each row once for its own group and once for the whole table.

    ``scope`` is ``group`` or ``global``; on global rows the group column is
    NULL, which the scope tells apart from a group whose name is missing.
    """
    kind = df.schema[group].dataType
    scopes = F.array(
        F.struct(F.lit("group").alias("scope"), F.col(group).alias("member")),
        F.struct(F.lit("global").alias("scope"), F.lit(None).cast(kind).alias("member")),
    )
    return (
        df.withColumn("__s", F.explode(scopes))
        .withColumns({"scope": F.col("__s.scope"), group: F.col("__s.member")})
        .drop("__s")
    )
