"""Which of many columns has the fewest distinct values, without counting most of them exactly.

One pass keeps a mergeable sketch per column, a flag for fractions and the least and largest value; rows are neither
multiplied nor shuffled.  A sketch's estimate stands for an interval; columns whose whole interval lies above the
upper end of the lowest one are out.  Only the columns left are counted exactly, one at a time, each by a distinct step of its
own that is combined on the map side.  Sketches never decide between columns that are close.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlift.sources.schema import is_numeric

#: Relative standard error of a sketch, and how many of them an interval reaches to either side.
ERROR, REACH = 0.01, 6


@dataclass(frozen=True)
class Standing:
    """A column after the race.  ``n_distinct`` is exact, or None for a column that left before exact counting."""

    column: str
    fractional: bool
    constant: bool
    estimate: int
    n_distinct: int | None


def survivors(estimates: dict[str, int]) -> list[str]:
    """Columns whose interval reaches down to the lowest interval's upper end."""
    if not estimates:
        return []
    reach = ERROR * REACH
    limit = min(estimates.values()) * (1 + reach)
    return [c for c, e in estimates.items() if e * (1 - reach) <= limit]


def race(df: DataFrame, candidates: Sequence[str]) -> list[Standing]:
    """Run all candidates; missing values are not values.  Fractional and constant columns cannot win and are not counted."""
    if not candidates:
        return []
    figures = []
    for i, c in enumerate(candidates):
        column = F.col(f"`{c}`")
        fractional = F.max((column % 1 != 0).cast("int")) if is_numeric(df, c) else F.lit(0)
        figures += [
            F.approx_count_distinct(column, ERROR).alias(f"n{i}"),
            F.coalesce(fractional, F.lit(0)).alias(f"f{i}"),
            (F.coalesce(F.min(column) != F.max(column), F.lit(False))).alias(f"v{i}"),
        ]
    row = df.agg(*figures).first()
    able = {c: row[f"n{i}"] for i, c in enumerate(candidates) if not row[f"f{i}"] and row[f"v{i}"]}
    exact = {c: df.select(F.col(f"`{c}`").alias("v")).where("v is not null").distinct().count() for c in survivors(able)}
    return [
        Standing(c, bool(row[f"f{i}"]), not row[f"v{i}"], row[f"n{i}"], exact.get(c)) for i, c in enumerate(candidates)
    ]


def winner(standings: Sequence[Standing]) -> str | None:
    """The column with the fewest distinct values; the first one wins a tie."""
    counted = [s for s in standings if s.n_distinct is not None]
    return min(counted, key=lambda s: s.n_distinct).column if counted else None
