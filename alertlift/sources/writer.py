"""Result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> str:
    """Overwrite one result table as Parquet or headered CSV."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_predictions(df: DataFrame, path: str) -> str:
    """Out-of-fold predictions, one folder per model, so that reading the
    winner touches only the winner's files."""
    return write_table(df, path, partition_by=["model"])
