"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(col: Column) -> Column:
    """NaN becomes NULL, so that averages and quantiles skip it."""
    return F.when(~F.isnan(col), col)


def cap_at(col: Column, limit: Column) -> Column:
    """Upper clip that keeps a missing value missing.

    A bare ``least`` would replace NULL by the limit.
    """
    return F.when(col.isNotNull(), F.least(col, limit))


def settle(col: Column) -> Column:
    """Round to 9 decimals.

    Averages over doubles depend on the order of summation in their last bits;
    without this a minute found with ``ceil`` could move when data is
    repartitioned.
    """
    return F.round(col, 9)


def r6(col: Column) -> Column:
    """Round to 6 decimals for reports; adding zero turns -0.0 into 0.0."""
    return F.round(col, 6) + F.lit(0.0)


def r6_probability(col: Column) -> Column:
    """``r6`` of a probability.  Rounding goes through decimal numbers, so what rounds to 0 or 1 is told by comparison."""
    one = (col > F.lit(1 - 4e-7)) & (col <= F.lit(1.0))  # NaN is above all numbers
    return F.when((col < F.lit(4e-7)) & (col >= F.lit(0.0)), F.lit(0.0)).when(one, F.lit(1.0)).otherwise(r6(col))


def hash_bucket(col: Column, buckets: int, seed: int) -> Column:
    """Bucket number from the first 32 bits of an md5 of seed and key.

    Depends on the key alone: not on row order, partitioning or engine.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")))
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return (head % F.lit(buckets)).cast("int")
