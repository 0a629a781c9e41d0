"""Reading alert and prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlift.functions.scalar import nan_to_null
from alertlift.sources.schema import KNOWN_TYPES

# Names of the prediction column in older result tables.
PREDICTION_NAMES = {"duration_pred_best": "duration_pred"}


def clean(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column; the others pass untouched, so
    filters on them still reach the files."""
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floating}) if floating else df


# Cells that stand for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Types tried for a column of unknown name, narrowest first.
GUESSES = (T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType())


def _cell(column: str) -> Column:
    cell = F.col(f"`{column}`")
    return F.when(~cell.isin(*MISSING), cell)


def _value(cell: Column, kind: T.DataType) -> Column:
    """The cell as ``kind``, NULL if it cannot be read.  Whole numbers may be
    written as "5.0" or as truth values and never pass through a double."""
    if not isinstance(kind, T.IntegralType):
        return cell.try_cast(kind)
    exact = cell.try_cast(T.DecimalType(38, 18))
    truth = F.lower(cell)
    return F.coalesce(
        cell.try_cast(kind),
        F.when(exact == F.floor(exact), exact).try_cast(kind),
        F.when(truth.isin("true", "false"), (truth == "true").cast(kind)),
    )


def _parsed(column: str, kind: T.DataType) -> Column:
    cell = _cell(column)
    if isinstance(kind, T.StringType):
        return cell.alias(column)
    value = _value(cell, kind)
    unreadable = F.raise_error(
        F.concat(F.lit(f"column {column}: not a {kind.simpleString()}: "), cell)
    )
    return (
        F.when(cell.isNotNull() & value.isNull(), unreadable.cast(kind))
        .otherwise(value)
        .alias(column)
    )


def _guess(raw: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    """First type that reads every cell, for all columns in one pass."""
    fits = {}
    for i, c in enumerate(columns):
        cell = _cell(c)
        fits[f"n_{i}"] = F.count(cell)
        for j, kind in enumerate(GUESSES):
            fits[f"n_{i}_{j}"] = F.count(_value(cell, kind))
    found = raw.agg(*[how.alias(name) for name, how in fits.items()]).first()
    types: dict[str, T.DataType] = {}
    for i, c in enumerate(columns):
        whole = [k for j, k in enumerate(GUESSES) if found[f"n_{i}_{j}"] == found[f"n_{i}"] > 0]
        types[c] = whole[0] if whole else T.StringType()
    return types


def _read_csv(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """Cells are read as text and parsed by name.  A cell that its column's
    type cannot hold ends the job that reads it, with column and cell named."""
    reader = spark.read.option("header", True)
    header = reader.csv(path).columns
    raw = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)
    types = {f.name: f.dataType for f in schema.fields} if schema else dict(KNOWN_TYPES)
    unknown = [c for c in header if c not in types]
    if unknown:
        # Only now is a pass over the data for types worth its price.
        types.update(_guess(raw, unknown))
    return raw.select(*[_parsed(c, types[c]) for c in header])


def load_alerts(
    spark: SparkSession,
    source: str | Sequence[str],
    schema: T.StructType | None = None,
    fmt: str = "csv",
) -> DataFrame:
    """First source that exists, with NaN turned into NULL.

    ``source`` is a path or an ordered list of fallbacks.  CSV columns get
    their type from ``schema`` or the known alert columns; files are scanned
    for types only if a column is in neither.
    """
    sources = [source] if isinstance(source, str) else list(source)
    for path in sources:
        try:
            if fmt == "csv":
                return clean(_read_csv(spark, path, schema))
            reader = spark.read.format(fmt)
            return clean((reader.schema(schema) if schema else reader).load(path))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of these sources exists: {', '.join(sources)}")


def load_predictions(
    spark: SparkSession, source: str | Sequence[str], fmt: str = "parquet"
) -> DataFrame:
    """Predictions with the canonical column name ``duration_pred``."""
    return load_alerts(spark, source, fmt=fmt).withColumnsRenamed(PREDICTION_NAMES)
