"""Trends and storm mix per airport."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlift.operators.joins import join_null_safe
from alertlift.operators.quantiles import exact_quantiles
from alertlift.sources.schema import target_column, trend_columns


def airport_trends(df: DataFrame, key: str | None = "alert_id") -> DataFrame:
    """Per airport: alerts, median and mean duration, mean of up to twelve
    numeric columns; busiest airport first.  A missing airport is a group.
    """
    duration = target_column(df.columns)
    numeric = trend_columns(df, key)
    means = df.groupBy("airport").agg(
        F.count("*").alias("n_alertes"),
        F.avg(duration).alias(f"{duration}_moyenne"),
        *[F.avg(c).alias(f"{c}_moyenne") for c in numeric],
    )
    medians = exact_quantiles(df, {f"{duration}_mediane": (duration, 0.5)}, ["airport"])
    return (
        join_null_safe(means, medians, ["airport"], "left")
        .select(
            "airport",
            "n_alertes",
            f"{duration}_mediane",
            f"{duration}_moyenne",
            *[f"{c}_moyenne" for c in numeric],
        )
        .orderBy(F.desc("n_alertes"), "airport")
    )


def storm_type_share(df: DataFrame, types: Sequence[int], digits: int | None = 2) -> DataFrame:
    """Share of each storm type per airport in percent, one column per type.

    Rows without airport or type are left out.  ``types`` names the columns,
    which saves the extra job a pivot needs to find them.  ``digits=None``
    leaves the shares unrounded.
    """
    known = df.dropna(subset=["airport", "storm_type"])
    counts = known.groupBy("airport").pivot("storm_type", list(types)).count()
    names = [str(t) for t in types]
    total = F.nullif(
        sum((F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names), F.lit(0)), F.lit(0)
    )
    shares = []
    for n in names:
        share = F.coalesce(F.col(f"`{n}`"), F.lit(0)) * F.lit(100.0) / total
        # Half to even, as the published report rounds.
        shares.append((share if digits is None else F.bround(share, digits)).alias(n))
    return counts.select("airport", *shares)


def present_types(df: DataFrame) -> list[int]:
    """The storm types present, for the columns of ``storm_type_share``."""
    types = df.select("storm_type").where("storm_type is not null").distinct()
    return sorted(types.toArrow().column("storm_type").to_pylist())
