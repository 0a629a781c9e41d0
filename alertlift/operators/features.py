"""Storm features: every step takes and returns a DataFrame of alerts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlift.functions.scalar import cap_at
from alertlift.operators.joins import attach_row
from alertlift.operators.quantiles import exact_quantiles
from alertlift.sources.schema import STORM_FEATURES

# Columns that are log-transformed and columns that are clipped.
LOG_COLUMNS = ("n_lightnings", "lightning_per_minute", "storm_surface")
CLIP_COLUMNS = ("mean_amplitude", "lightning_per_minute")
CLIP_AT = 0.99


def add_speed(df: DataFrame) -> DataFrame:
    lat, lon = F.col("lat_delta"), F.col("lon_delta")
    return df.withColumn("speed", F.sqrt(lat * lat + lon * lon))


def add_surface(df: DataFrame) -> DataFrame:
    return df.withColumn("storm_surface", F.col("lat_std") * F.col("lon_std"))


def add_cyclic_hour(df: DataFrame) -> DataFrame:
    angle = F.lit(2 * math.pi) * F.col("start_hour") / F.lit(24)
    return df.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)})


def add_logs(df: DataFrame, columns: Sequence[str] = LOG_COLUMNS) -> DataFrame:
    """``log_x = ln(1 + x)``; inputs are counts, rates and areas, never below 0."""
    return df.withColumns({f"log_{c}": F.log1p(F.col(c)) for c in columns})


def clip_high(
    df: DataFrame,
    columns: Sequence[str] = CLIP_COLUMNS,
    probability: float = CLIP_AT,
    approx: bool = False,
) -> DataFrame:
    """Cap each column at its own quantile; missing values stay missing.

    ``approx=True`` trades the exact quantile for one pass with a sketch.
    """
    if approx:
        limits = df.agg(
            *[F.percentile_approx(c, probability, 10_000).alias(f"__{c}") for c in columns]
        )
    else:
        limits = exact_quantiles(df, {f"__{c}": (c, probability) for c in columns})
    capped = {c: cap_at(F.col(c), F.col(f"__{c}")) for c in columns}
    return attach_row(df, limits).withColumns(capped).drop(*[f"__{c}" for c in columns])


def storm_features(df: DataFrame) -> DataFrame:
    """All derived columns; logs are taken before the clip."""
    return clip_high(add_logs(add_cyclic_hour(add_surface(add_speed(df)))))


def drop_incomplete(df: DataFrame, columns: Sequence[str] = STORM_FEATURES) -> DataFrame:
    return df.dropna(subset=list(columns))


def z_scores(
    df: DataFrame, columns: Sequence[str] = STORM_FEATURES, prefix: str = "z_"
) -> DataFrame:
    """``(x - mean) / population sd`` per column, statistics in one pass.

    A constant column has no spread and scores 0.
    """
    stats = df.agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns],
    )
    scores = {}
    for c in columns:
        spread = F.when(F.col(f"__s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__s_{c}"))
        scores[f"{prefix}{c}"] = (F.col(c) - F.col(f"__m_{c}")) / spread
    helpers = [f"__{kind}_{c}" for kind in "ms" for c in columns]
    return attach_row(df, stats).withColumns(scores).drop(*helpers)


def category_levels(df: DataFrame, column: str) -> list[str]:
    """Distinct non-NULL values, sorted: the schema of a wide one-hot table.

    One output column per level must fit on the driver by its nature; training
    encodes levels as sparse vectors instead and has no such need.
    """
    level = F.col(column).cast("string").alias("level")
    rows = df.select(level).where("level is not null").distinct().toArrow()
    return sorted(rows.column("level").to_pylist())


def one_hot(df: DataFrame, column: str, levels: Sequence[str] | None = None) -> DataFrame:
    """Replace a text column by one 0/1 column per level, none left out.

    NULL and levels not listed give zeros everywhere.
    """
    if levels is None:
        levels = category_levels(df, column)
    text = F.col(column).cast("string")
    flags = [
        F.when(text.eqNullSafe(F.lit(v)), 1).otherwise(0).alias(f"{column}_{v}") for v in levels
    ]
    return df.select(*[c for c in df.columns if c != column], *flags)


def only_airport(df: DataFrame, airport: str | None = None) -> DataFrame:
    """One airport, or all when none is named."""
    return df if airport is None else df.where(F.col("airport") == airport)


def airports(df: DataFrame) -> DataFrame:
    return df.select("airport").distinct()
