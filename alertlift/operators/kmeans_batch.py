"""K-means from several starts at once: one pass over the data moves the centres of all starts.

Starts that have settled drop out of later passes.  Coordinates are added up as whole multiples of ``GRAIN``, so centres do
not depend on the order of rows, and a rerun gives the same types.  Equal rows are counted once, before the first pass, and
travel as packed blocks of coordinates with their numbers, so that a pass reads bytes and multiplies matrices.  The first centres come from a bounded sample, drawn by
a hash, by weighting with the squared distance to the centres chosen so far; they settle on the sample before the first
pass over all rows, which then needs few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlift.operators.storms import CENTRE_SHIFT, MAX_ITERATIONS, RESTARTS, SEED, TYPES
from alertlift.sources.shipping import ship_package
from alertlift.sources.staging import stage

GRAIN = 2.0**-24
#: Rows that first centres are chosen from, and rows that a pass takes at a time.
SAMPLE_ROWS, CHUNK_ROWS = 20_000, 8_192


def first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` rows of the sample, each drawn with the squared distance to the nearest chosen one as its weight."""
    draw = np.random.default_rng(seed)
    chosen = [sample[draw.integers(len(sample))]]
    while len(chosen) < k:
        away = np.min([((sample - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        total = away.sum()
        chosen.append(sample[draw.choice(len(sample), p=away / total)] if total > 0 else chosen[-1])
    return np.array(chosen)


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and start the nearest centre and its squared distance; ``centres``: starts by k by columns."""
    starts, k, d = centres.shape
    flat = centres.reshape(-1, d)
    apart = (rows**2).sum(axis=1)[:, None] - 2 * rows @ flat.T + (flat**2).sum(axis=1)
    apart = np.maximum(apart, 0).reshape(len(rows), starts, k)
    at, least = np.zeros((len(rows), starts), dtype=np.int64), apart[:, :, 0].copy()
    for c in range(1, k):
        less = apart[:, :, c] < least
        at[less] = c
        np.minimum(least, apart[:, :, c], out=least)
    return at, least


def settle(sample: np.ndarray, centres: np.ndarray, iterations: int, shift: float) -> np.ndarray:
    """The centres of one start after moving them over the sample alone."""
    for _ in range(iterations):
        at = nearest(sample, centres[None])[0][:, 0]
        counts = np.bincount(at, minlength=len(centres))[:, None]
        sums = np.stack([np.bincount(at, weights=x, minlength=len(centres)) for x in sample.T], axis=1)
        moved = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
        still = ((moved - centres) ** 2).sum(axis=1).max() > shift**2
        centres = moved
        if not still:
            break
    return centres


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows ``x`` and their numbers ``n`` as one row of bytes per batch."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            counts = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["rows", "counts"])


def member_sums(at: np.ndarray, k: int, values: np.ndarray) -> np.ndarray:
    """Sums of whole ``values`` (rows by columns) per start and centre, exact: products of floats as long as these stay
    below 2**53, else in halves."""
    if len(values) * float(np.abs(values).max(initial=0)) >= 1 << 52:
        high = values >> 24
        return (member_sums(at, k, high) << 24) + member_sums(at, k, values - (high << 24))
    own = values.astype(np.float64)
    return np.stack([(at == c).astype(np.float64).T @ own for c in range(k)], axis=1).astype(np.int64)


def _pass(centres: np.ndarray):  # noqa: ANN202
    """Per task: sums of coordinates, counts and costs of each start and centre."""
    starts, k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, costs = np.zeros((starts, k, d + 1), dtype=np.int64), np.zeros(starts)
        for batch in batches:
            for packed, numbers in zip(batch.column("rows").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                every, counts = np.frombuffer(packed).reshape(-1, d), np.frombuffer(numbers, dtype=np.int64)
                for begin in range(0, len(every), CHUNK_ROWS):
                    rows, n = every[begin : begin + CHUNK_ROWS], counts[begin : begin + CHUNK_ROWS]
                    at, apart = nearest(rows, centres)
                    costs += n @ apart
                    whole = np.column_stack([np.rint(rows / GRAIN).astype(np.int64) * n[:, None], n])
                    sums += member_sums(at, k, whole)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([costs.tobytes()], pa.binary())], ["sums", "costs"])

    return run


_PARTS = "sums binary, costs binary"


@dataclass
class Clusters:
    """Centres by type, largest type first, and the cost of every start."""

    centres: np.ndarray
    sizes: list[int]
    costs: list[float]
    best: int

    def label(self, vector: Column) -> Column:
        """The type of a vector (array of doubles)."""
        apart = F.array(
            *[
                sum(((vector[j] - F.lit(float(v))) ** 2 for j, v in enumerate(centre)), F.lit(0.0))
                for centre in self.centres
            ]
        )
        return (F.array_position(apart, F.array_min(apart)) - 1).cast("int")


def fit_starts(
    vectors: DataFrame, k: int = TYPES, seed: int = SEED, restarts: int = RESTARTS, name: str = "z",
    iterations: int = MAX_ITERATIONS, shift: float = CENTRE_SHIFT,
) -> Clusters:
    """The cheapest of several starts; ``vectors`` should be staged, it is read once."""
    ship_package(vectors.sparkSession)
    counted = stage(vectors.groupBy(vector_to_array(F.col(name)).alias("x")).agg(F.count("*").alias("n")))
    n = counted.agg(F.sum("n")).first()[0] or 0
    share = F.lit(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 30))
    drawn = sorted(counted.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < share).collect())
    sample = np.repeat(np.array([r.x for r in drawn]), np.array([r.n for r in drawn], dtype=np.int64), axis=0)
    if not len(sample):
        raise ValueError("no rows to cluster")
    rows = stage(counted.mapInArrow(_pack, "rows binary, counts binary"))
    centres = np.array([settle(sample, first_centres(sample, k, seed + i), iterations, shift) for i in range(restarts)])
    costs, sizes = np.full(restarts, np.inf), np.zeros((restarts, k), dtype=np.int64)
    active = np.arange(restarts)
    for _ in range(iterations):
        parts = rows.mapInArrow(_pass(centres[active]), _PARTS).collect()
        shape = (len(active), k, centres.shape[2] + 1)
        sums = sum(np.frombuffer(bytes(p.sums), dtype=np.int64) for p in parts).reshape(shape)
        costs[active] = sum(np.frombuffer(bytes(p.costs)) for p in parts)
        sizes[active] = sums[:, :, -1]
        filled = sums[:, :, -1:] > 0
        moved = np.where(filled, sums[:, :, :-1] * GRAIN / np.maximum(sums[:, :, -1:], 1), centres[active])
        still = ((moved - centres[active]) ** 2).sum(axis=2).max(axis=1) > shift**2
        # A settled start keeps the centres that its sizes and cost belong to.
        centres[active[still]] = moved[still]
        active = active[still]
        if not len(active):
            break
    best = min(range(restarts), key=lambda i: (float(f"{costs[i]:.9g}"), i))
    order = sorted(range(k), key=lambda c: (-sizes[best, c], c))
    return Clusters(centres[best][order], sizes[best][order].tolist(), costs.tolist(), best)
