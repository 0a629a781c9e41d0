"""Near-duplicate vectors by E8 lattice hashing (operator 4).

Vectors are scaled to length one and projected at random to ``8 * blocks`` dimensions; every block of eight is decoded
to its nearest point of the lattice E8.  The points of all blocks name a cell of one table.  A vector lies in its own
cell and looks into ``PROBES`` neighbouring cells: those of the 240 shortest lattice steps, over all blocks, that
come closest to it.  A pair is compared, by cosine in double precision, when one vector's own cell is among the cells
of the other in any table.  Only pairs that reach the threshold link.

Blocks grow with the logarithm of the number of vectors, so that a cell holds a few unrelated vectors at any size.  The
number of tables follows from a simulation with pairs exactly at the threshold: one is missed with a probability
below ``MISS``; closer pairs are missed less.

Equal vectors are one class and compared once.  A cell is cut into blocks of rows, and pairs of blocks are compared as
matrices, so a hot cell is many small tasks; rows are sent only for cells with partners.

Each length that occurs has projections of its own, unless its vectors fit one block: then all of them are compared.

Defined results: a vector that is null, empty, zero or holds a null or a non-finite component links with nothing, others
link with vectors of their own length; repeated rows link like copies; a row without vec_id links with
nothing and is kept; an empty table gives no rows.  Only vec_id and embedding are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.llm import textarrays as ta
from alertlift.llm.components import components
from alertlift.llm.shipping import ship
from alertlift.sources.staging import stage

AT_LEAST = 0.95
MISS = 0.001
SCALE, PROBES = 3.5, 4
#: Rows of a block of a cell, on average; unrelated vectors per cell that are aimed at.
ROWS, ALONE = 256, 8
#: Two unrelated vectors share a block's lattice point with this probability at SCALE, about.
_SHARED_POINT = 0.0125
SEED = 4


def steps() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [
        [x if k == i else y if k == j else 0.0 for k in range(8)]
        for i, j in itertools.combinations(range(8), 2)
        for x in (1.0, -1.0)
        for y in (1.0, -1.0)
    ]
    half = [v for v in itertools.product((0.5, -0.5), repeat=8) if v.count(-0.5) % 2 == 0]
    return np.array(whole + half)


_STEPS = steps()


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and mend an odd sum at the coordinate rounded worst."""
    point = np.rint(y)
    off = y - point
    odd = point.sum(axis=1) % 2 != 0
    worst = np.abs(off).argmax(axis=1)
    row = np.arange(len(y))
    point[row, worst] += np.where(odd, np.where(off[row, worst] >= 0, 1.0, -1.0), 0.0)
    return point


def nearest(y: np.ndarray) -> np.ndarray:
    """Nearest point of E8: the even points, or the same shifted by one half."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    closer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def cells(y: np.ndarray, blocks: int, probes: int) -> np.ndarray:
    """Names (64-bit hashes) of the own cell and of the probed ones, one column each."""
    row = np.arange(len(y))
    own = [nearest(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)]
    added = np.concatenate([-2 * (y[:, 8 * b : 8 * b + 8] - own[b]) @ _STEPS.T for b in range(blocks)], axis=1)
    closest = np.argpartition(added, probes, axis=1)[:, :probes]
    point = np.rint(2 * np.concatenate(own, axis=1)).astype(np.int64)
    factors = ta.mix(np.arange(1, 8 * blocks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    # A name is a mixed sum over coordinates, so a step changes the sum by the step's own sum.
    total = (point.view(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
    whole = np.rint(2 * _STEPS).astype(np.int64).view(np.uint64)
    by_step = np.stack([(whole * factors[8 * b : 8 * b + 8]).sum(axis=1, dtype=np.uint64) for b in range(blocks)]).reshape(-1)
    names = [total, *(total + by_step[closest[row, p]] for p in range(probes))]
    return ta.mix(np.stack(names, axis=1))


class Tables:
    """Random projections of all tables."""

    def __init__(self, dimensions: int, rows: int, at_least: float = AT_LEAST, seed: int = SEED):
        self.blocks = max(1, int(np.ceil(np.log(max(rows / ALONE, 2)) / -np.log(_SHARED_POINT))))
        random = np.random.default_rng(seed)
        self.dimensions, self._random = dimensions, random
        found = self._found(at_least)
        count = int(np.ceil(np.log(MISS) / np.log(1 - min(found, 0.999))))
        self.projections = [self._projection() for _ in range(max(count, 2))]

    def _projection(self) -> np.ndarray:
        """Orthonormal columns for each block where there are dimensions enough, scaled to keep expected lengths."""
        raw = self._random.normal(size=(self.blocks, max(self.dimensions, 8), 8))
        columns = np.concatenate([np.linalg.qr(x)[0][: self.dimensions] for x in raw], axis=1)
        return columns * SCALE * np.sqrt(max(self.dimensions, 8) / 64)

    def _found(self, cosine: float, pairs: int = 4000) -> float:
        """Share of random pairs at this cosine that one table finds."""
        x = self._random.normal(size=(pairs, self.dimensions))
        z = self._random.normal(size=x.shape)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        y = cosine * x + np.sqrt(1 - cosine**2) * z
        projection = self._projection()
        a, b = (cells(v @ projection, self.blocks, PROBES) for v in (x, y))
        return float(((a == b[:, :1]) | (b == a[:, :1])).any(axis=1).mean())

    def names(self, unit: np.ndarray) -> np.ndarray:
        """Tables x (own cell and probes) for each row."""
        out = [cells(unit @ p, self.blocks, PROBES) ^ ta.mix(np.uint64([t + 1]))[0] for t, p in enumerate(self.projections)]
        return np.stack(out, axis=1)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, the vector as doubles of length one (null where it can't link), and its length."""
    for batch in batches:
        out = []
        for value in batch.column(1).to_pylist():
            vector = None
            if value and None not in value:
                x = np.array(value, dtype=np.float64)
                if np.isfinite(x).all():
                    big = np.abs(x).max()
                    if big > 0:
                        x = x / big
                        vector = (x / np.sqrt((x * x).sum())).astype("<f8").tobytes()
            out.append(vector)
        size = pa.array([None if v is None else len(v) // 8 for v in out], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), size], ["vec_id", "unit", "size"])


def _entries(tables) -> Callable:  # noqa: ANN001  a broadcast
    """Cells of each vector.  Vectors of a length that has no tables all share one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy()
            for length in np.unique(size):
                mine = batch.filter(pa.array(size == length))
                name = ta.mix(np.array([length], dtype=np.uint64))
                for first in range(0, mine.num_rows, 2048):
                    part = mine.slice(first, 2048)
                    if int(length) in tables.value:
                        unit = np.stack([np.frombuffer(v.as_buffer(), "<f8") for v in part.column(1)])
                        names = tables.value[int(length)].names(unit) ^ name
                    else:
                        names = np.tile(name, (part.num_rows, 1, 1))
                    n, t, p = names.shape
                    own = np.zeros((n, t, p), dtype=bool)
                    own[:, :, 0] = True
                    ids = part.column(0).take(pa.array(np.repeat(np.arange(n), t * p)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(names.reshape(-1).view(np.int64)), pa.array(own.reshape(-1))], ["id", "cell", "own"])

    return run


def _compare(at_least: float) -> Callable:
    """Links between two blocks of a cell: rows at home there, and rows at home or looking in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values for c in (0, 1))
                ids = [x.field("id").to_numpy(zero_copy_only=False) for x in (a, b)]
                x, y = ([np.frombuffer(v.as_buffer(), "<f8") for v in z.field("unit")] for z in (a, b))
                if len({len(v) for v in (*x, *y)}) > 1:
                    raise ValueError("vectors of two lengths in one cell: two cells have one hash")
                p, q = np.nonzero(np.stack(x) @ np.stack(y).T >= at_least)
                p, q = ids[0][p], ids[1][q]
                differ = p != q
                low, high = np.minimum(p, q)[differ], np.maximum(p, q)[differ]
                if len(low):
                    yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    return run


def near_duplicates(vectors: DataFrame, at_least: float = AT_LEAST, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links, component_id, kept) of every row, and the links (a, b) between classes of equal direction.

    ``vectors``: vec_id (whole number) and embedding (array of numbers).
    """
    spark = ship(vectors.sparkSession)
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    clean = stage(source.mapInArrow(_clean, "vec_id long, unit binary, size int"))
    able = clean.filter("unit is not null and vec_id is not null")
    everyone = clean.select("vec_id", "unit")
    classes = stage(able.groupBy("unit").agg(F.min("vec_id").alias("id"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies")))
    # Vectors of one length link with one another only; each length that does not fit a block has tables of its own.
    lengths = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    tables = spark.sparkContext.broadcast({size: Tables(size, n, at_least) for size, n in lengths.items() if n > rows})
    entries = stage(classes.select("id", "unit", "size").mapInArrow(_entries(tables), "id long, cell long, own boolean"))
    # A cell matters if it is the home of a row and another row comes to it; its rows are dealt to blocks.
    counted = entries.groupBy("cell").agg(F.count_if("own").alias("at_home"), F.count(F.lit(1)).alias("all"))
    useful = stage(counted.filter("at_home >= 1 and all >= 2"))
    dealt = entries.join(useful, "cell").join(classes.select("id", "unit"), "id")
    salt = lambda n: F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / rows))
    gather = F.collect_list(F.struct("id", "unit"))
    visitors = dealt.withColumn("v", salt("all")).groupBy("cell", "v").agg(gather.alias("y"))
    homes = dealt.filter("own").withColumn("h", salt("at_home")).groupBy("cell", "h").agg(gather.alias("x"))
    found = homes.join(visitors, "cell").select("x", "y").mapInArrow(_compare(at_least), "a long, b long")
    links = stage(found.distinct())

    size = lambda side: classes.select(F.col("id").alias(side), F.col("copies").alias("n"))
    both = links.join(size("b"), "b").select(F.col("a").alias("id"), "n").union(links.join(size("a"), "a").select(F.col("b").alias("id"), "n"))
    others = both.groupBy("id").agg(F.sum("n").alias("others"))
    merged = components(links).withColumnRenamed("node", "id")
    of_class = classes.join(others, "id", "left").join(merged, "id", "left").select(
        "unit", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    result = everyone.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("unit"))).join(of_class.withColumnRenamed("unit", "key"), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    ), links


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
