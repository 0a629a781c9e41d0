"""Alert table schema and the choice of columns from a schema.

Columns are found by name and type, so one job runs on tables with different
column sets.  Nothing here reads rows, except the two profiling aggregates of
the cluster-label search.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted target names, in order of preference.
TARGETS = ("duration_total_minutes", "duration_minutes")

# Known alert columns by type.
LONG_COLUMNS = ("alert_id", "alert_airport_id", "n_lightnings", "n_cloud_ground", "n_intra_cloud")
INT_COLUMNS = (
    "is_last_cloud",
    "last_lightning_is_cg",
    "start_hour",
    "start_year",
    "start_month",
    "start_dayofyear",
    "storm_type",
)
DOUBLE_COLUMNS = (
    "duration_total_minutes",
    "duration_minutes",
    "lightning_per_minute",
    "density",
    "ic_ratio",
    "mean_amplitude",
    "lat_std",
    "lon_std",
    "mean_dist",
    "prox_ratio",
    "lat_delta",
    "lon_delta",
    "min_dist",
    "mean_azimuth_sin",
    "mean_azimuth_cos",
    "std_dist",
    "mean_maxis",
    "max_maxis",
    "std_maxis",
    "storm_size_km",
    "lat_mean",
    "lon_mean",
    "speed",
    "storm_surface",
    "hour_sin",
    "hour_cos",
    "log_n_lightnings",
    "log_lightning_per_minute",
    "log_storm_surface",
    "pca_1",
    "pca_2",
)
TIME_COLUMNS = ("start_time", "end_time", "last_cloud_ground_time")
TEXT_COLUMNS = ("airport",)

KNOWN_TYPES: dict[str, T.DataType] = {
    **{c: T.LongType() for c in LONG_COLUMNS},
    **{c: T.IntegerType() for c in INT_COLUMNS},
    **{c: T.DoubleType() for c in DOUBLE_COLUMNS},
    **{c: T.TimestampType() for c in TIME_COLUMNS},
    **{c: T.StringType() for c in TEXT_COLUMNS},
}

# Numeric features a model may use, in order.
ALLOWED_NUMERIC = (
    "n_lightnings",
    "n_cloud_ground",
    "n_intra_cloud",
    "mean_dist",
    "std_dist",
    "mean_amplitude",
    "start_year",
    "start_month",
    "start_dayofyear",
    "start_hour",
    "mean_maxis",
    "max_maxis",
    "density",
    "last_lightning_is_cg",
    "storm_size_km",
)

# The seven features that describe a storm for clustering.
STORM_FEATURES = (
    "ic_ratio",
    "mean_amplitude",
    "speed",
    "lat_std",
    "lon_std",
    "mean_dist",
    "prox_ratio",
)

# Words and names used to recognise clustering output.
SCORE_WORDS = ("proba", "prob", "score", "soft", "membership")
SUBJECT_WORDS = ("cluster", "storm", "type")
LABEL_NAMES = (
    "cluster",
    "clusters",
    "cluster_id",
    "cluster_label",
    "kmeans",
    "kmeans_label",
    "storm_type",
    "stormtype",
    "type_orage",
    "storm_cluster",
)
NEVER_LABELS = (
    "duration_total_minutes",
    "airport",
    "alert_airport_id",
    "start_time",
    "end_time",
    "last_cloud_ground_time",
)
# Fixed value: the level that a missing category gets.
MISSING_LEVEL = "nan"
# Columns without a trend, and how many get one.
NOT_IN_TRENDS = ("storm_type", "alert_airport_id")
TREND_LIMIT = 12


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def target_column(columns: Iterable[str]) -> str:
    """First accepted target that is present."""
    present = set(columns)
    for name in TARGETS:
        if name in present:
            return name
    raise ValueError(f"no target column; expected one of {', '.join(TARGETS)}")


def with_label(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Every column but the target, plus the target as ``label: double``.

    ``exclude`` drops columns that are only known once the alert is over,
    such as its end time or rates divided by its duration.
    """
    target = target_column(df.columns)
    features = [c for c in df.columns if c != target and c not in exclude]
    return df.select(*features, F.col(target).cast("double").alias("label"))


def allowed_features(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) features from the allow-list that are present."""
    numeric = [c for c in ALLOWED_NUMERIC if c in df.columns]
    categorical = [c for c in ("airport",) if c in df.columns]
    return numeric, categorical


def trend_columns(
    df: DataFrame, key: str | None = None, limit: int = TREND_LIMIT
) -> list[str]:
    """First ``limit`` numeric columns in table order, without target, label,
    airport code, unnamed index columns and the row key ``key``."""
    skip = {target_column(df.columns), *NOT_IN_TRENDS, key}
    found = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in skip
        and not f.name.startswith("Unnamed")
    ]
    return found[:limit]


def cluster_score_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose name says "score of a cluster", sorted."""
    found = []
    for field in df.schema.fields:
        name = field.name.lower()
        if (
            any(w in name for w in SCORE_WORDS)
            and any(w in name for w in SUBJECT_WORDS)
            and isinstance(field.dataType, (T.NumericType, T.BooleanType))
        ):
            found.append(field.name)
    return sorted(set(found))


def cluster_label_names(df: DataFrame) -> list[str]:
    """Columns whose name suggests a cluster label, in table order."""
    prefixes = tuple(n + "_" for n in LABEL_NAMES)
    found = []
    for column in df.columns:
        name = column.lower()
        if column not in NEVER_LABELS and (
            name in LABEL_NAMES or name.startswith(prefixes) or "cluster" in name
        ):
            found.append(column)
    return found


def profile_labels(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """One row: distinct non-NULL values and a fractional flag per candidate.

    All candidates share one aggregate; the distinct step is spread over the
    values, so no task holds a whole column.
    """
    aggregates = []
    for c in candidates:
        fractional = (F.col(c) % 1 != 0) if is_numeric(df, c) else F.lit(False)
        aggregates += [
            F.count_distinct(F.col(c)).alias(f"{c}_distinct"),
            F.coalesce(F.max(fractional.cast("int")), F.lit(0)).alias(f"{c}_fractional"),
        ]
    return df.agg(*aggregates)


def pick_cluster_label(
    df: DataFrame, candidates: Sequence[str] | None = None, profile: Row | None = None
) -> str | None:
    """Candidate with the fewest distinct values; fractional numbers and
    constants are out, the first one wins a tie.  ``profile`` is the row of
    ``profile_labels`` where it is known already."""
    if candidates is None:
        candidates = cluster_label_names(df)
    if not candidates:
        return None
    row = profile if profile is not None else profile_labels(df, candidates).first()
    usable = [
        c for c in candidates if not row[f"{c}_fractional"] and row[f"{c}_distinct"] > 1
    ]
    return min(usable, key=lambda c: row[f"{c}_distinct"], default=None)


def with_cluster_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Allow-listed features plus detected clustering output, no duplicates."""
    numeric, categorical = allowed_features(df)
    label = pick_cluster_label(df)
    numeric += [c for c in cluster_score_columns(df) if c not in numeric]
    if label is not None and label not in categorical:
        categorical.append(label)
    return numeric, categorical


def cast_categoricals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as text; a missing value is a level of its own."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL)) for c in columns}
    )
