"""One encoded table for all fits: bins of every feature under the statistics of each training set.

A row holds its label as a whole number of ``UNIT``, its outer and inner fold, and one block of bins per outer fold
(encoded by the rows outside that fold) and one more for fits on all rows.  Which rows a fit trains on is a condition on the
two folds, so nested searches read this one table and copy nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlift.operators.folds import FOLDS, SEED, assign_folds
from alertlift.sources.shipping import ship_package
from alertlift.sources.staging import keep_staged, stage, staged_scope

UNIT = 1e-6
MAX_BINS = 128
#: Cut points come from at most about so many rows, drawn by a hash of their key.
SAMPLE_ROWS = 65_536
#: Text columns become one feature per level; more levels than this are an error.
MAX_LEVELS = 1_000


@dataclass(frozen=True)
class Encoded:
    """``rows``: row, fold, inner, y, bins and the key columns; ``names`` of the p features of each of k + 1 blocks."""

    rows: DataFrame
    names: tuple[str, ...]
    k: int
    keys: tuple[str, ...]

    def block(self, held: int | None) -> int:
        return self.k if held is None else held


def cut_points(values: np.ndarray, bins: int = MAX_BINS) -> np.ndarray:
    """Ascending cuts between distinct values, as equally filled as they allow; a value equal to a cut is below it."""
    values = values[~np.isnan(values)]
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) < 2:
        return np.empty(0)
    middle = (distinct[1:] + distinct[:-1]) / 2
    if len(middle) < bins:
        return middle
    filled = np.cumsum(counts)[:-1]
    wanted = filled[-1] * np.arange(1, bins) / bins
    return middle[np.unique(np.minimum(np.searchsorted(filled, wanted), len(middle) - 1))]


def _binned(cuts: list[list[np.ndarray]], levels: list[list[tuple[int, str]]], n_numeric: int):  # noqa: ANN202
    """Arrow batches of (keys..., fold, inner, y, numerics..., texts...) to those without the features, plus ``bins``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            first = names.index("__y") + 1
            numbers = [
                batch.column(first + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n_numeric)
            ]
            texts = [batch.column(i).to_pylist() for i in range(first + n_numeric, len(names))]
            blocks = []
            for own, known in zip(cuts, levels, strict=True):
                columns = [
                    np.where(np.isnan(x), 0, np.searchsorted(c, x, side="left") + 1)
                    for x, c in zip(numbers, own, strict=True)
                ]
                columns += [np.fromiter((t == level for t in texts[i]), dtype=np.uint8, count=n) for i, level in known]
                blocks.append(np.stack(columns, axis=1).astype(np.uint8))
            flat = np.ascontiguousarray(np.concatenate(blocks, axis=1))
            width = flat.shape[1]
            offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(first)), packed], names=[*names[:first], "__bins"]
            )

    return run


def encode(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    k: int = FOLDS,
    inner_folds: int = FOLDS,
    key: str = "alert_id",
    keep: Sequence[str] = ("alert_id", "airport"),
) -> Encoded:
    """Encode a table with ``label`` and ``fold``.  A missing number has a bin below all others; a missing or unknown
    level is 0 in each of its column's features."""
    spark = ship_package(df.sparkSession)
    with staged_scope(spark):
        inner = assign_folds(df, key, inner_folds, SEED + 1, "__inner")
        folds = inner.select(
            *keep, F.col("fold").cast("int").alias("__fold"), F.col("__inner").cast("int"),
            F.round(F.col("label") / UNIT).cast("long").alias("__y"),
            *[F.col(c).cast("double").alias(c if c not in keep else f"__n_{c}") for c in numeric],
            *[F.col(c).cast("string").alias(f"__t_{c}") for c in categorical],
        )
        folds = stage(folds.where("__y is not null"))
        numbers = folds.columns[len(keep) + 3 : len(keep) + 3 + len(numeric)]
        n = folds.count()
        share = min(1.0, SAMPLE_ROWS / max(n, 1))
        drawn = folds.where(F.pmod(F.xxhash64(*keep, "__y"), F.lit(1 << 30)) < int(share * (1 << 30)))
        sample = drawn.select("__fold", *numbers).toPandas()
        found = [
            (i, r[0], r[1]) for i, c in enumerate(categorical)
            for r in folds.groupBy(f"__t_{c}", "__fold").agg(F.lit(1)).where(F.col(f"__t_{c}").isNotNull()).limit(k * MAX_LEVELS + 1).collect()
        ]
        every = sorted({(i, level) for i, level, _ in found})
        if len(every) > MAX_LEVELS:
            raise ValueError(f"more than {MAX_LEVELS} levels: leave the column out or group its levels first")
        cuts, levels = [], []
        for held in (*range(k), None):
            own = sample[sample["__fold"] != held]
            cuts.append([cut_points(own[c].to_numpy(dtype=np.float64), MAX_BINS - 2) for c in numbers])
            seen = {(i, level) for i, level, fold in found if fold != held}
            # A level that training never saw keeps its place and is 0 for all rows.
            levels.append([(i, level if (i, level) in seen else "\0unseen") for i, level in every])
        keys = ", ".join(f"`{c}` {folds.schema[c].dataType.simpleString()}" for c in keep)
        binned = folds.mapInArrow(
            _binned(cuts, levels, len(numeric)), f"{keys}, __fold int, __inner int, __y long, __bins binary"
        )
        rows = keep_staged(binned.withColumn("__row", F.monotonically_increasing_id()))
        names = [*numeric, *[f"{categorical[i]}_{level}" for i, level in every]]
        return Encoded(rows, tuple(names), k, tuple(keep))


def thick(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have so many rows: work per batch and tree is spent on fewer of them.  No empty ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass
class Block:
    """Arrays of one batch of encoded rows."""

    row: np.ndarray
    fold: np.ndarray
    inner: np.ndarray
    y: np.ndarray
    bins: np.ndarray  # rows, blocks, features

    @staticmethod
    def of(batch: pa.RecordBatch, blocks: int) -> Block:
        whole = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        packed = batch.column("__bins").cast(pa.large_binary())
        n = len(packed)
        offsets = np.frombuffer(packed.buffers()[1], dtype=np.int64)[packed.offset : packed.offset + n + 1]
        flat = np.frombuffer(packed.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        return Block(whole("__row"), whole("__fold"), whole("__inner"), whole("__y"), flat.reshape(n, blocks, -1))


BLOCK_COLUMNS = ("__row", "__fold", "__inner", "__y", "__bins")
