"""Mixing sources to target weights by pivotal dependent rounding (operator 6).

Every document of a source gets the same expected number of copies, target / source size.  The whole part is
taken for sure.  The fractions are rounded by pivots: two fractional documents exchange mass, weighted by their
sizes, until one of them is integral; the other goes on to the next document.  An exchange keeps the sum of
fraction * size exactly and each fraction's expectation, so a source misses its target by at most one document.

The exchanges run as a reduction tree: documents are dealt to chunks by a hash of their id (a hot source is
spread over all chunks), a chunk leaves at most one fractional document per source, and the residuals of
``FAN_IN`` chunks meet in the next level until one chunk is left.  Random numbers are hashes of the ids, and each
chunk is sorted, so reruns agree.

Defined results: a null text has size 0 and is taken 0 times its size; a null source is a source of its own,
ordered last; sources without words have target 0; repeated rows are separate documents; an empty table gives an
empty mix.  Only doc_id, text and source are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlift.llm.shipping import ship
from alertlift.sources.staging import keep_staged, stage, staged_scope

#: Weights by a source's place in code point order, repeating; share of all words that the mix holds; most copies.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
CHUNK_ROWS = 5_000
FAN_IN = 64
SEED = 20

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of the whole text (null: 0)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """One row per source: source_size, weight and target.

    Capped sharing has one level: target = min(most * size, level * weight).  Sources are ordered by the level at
    which they reach their cap; running sums give, at each, the level that all later sources would have.  The
    level is the first that does not exceed its source's own.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn("place", F.row_number().over(in_order) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))
    )
    cap = most * F.col("source_size")
    at_cap = Window.orderBy(cap / F.col("weight"), "place")
    everything = Window.partitionBy()
    earlier = at_cap.rowsBetween(Window.unboundedPreceding, -1)
    later = at_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * share
    level = (total - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    return (
        ranked.withColumn("own", cap / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("own"), F.col("level"))).over(everything))
        .select("source", "source_size", "weight", F.least(cap, F.coalesce("level", F.lit(float("inf"))) * F.col("weight")).alias("target"))
    )


def _exchange(a: float, b: float, size_a: int, size_b: int, u: float) -> tuple[float, float]:
    """Move weighted mass between two fractions until one is 0 or 1; the sum of fraction * size stays.

    Either a rises and b falls, or the other way round, each as far as it goes; the odds are inverse to the two
    distances, which keeps both expectations.
    """
    up = min((1 - a) * size_a, b * size_b)
    down = min(a * size_a, (1 - b) * size_b)
    move = up if u * (up + down) < down else -down
    a, b = a + move / size_a, b - move / size_b
    near = lambda x: 0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x
    return near(a), near(b)


def _pivot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (chunk, source): round all but at most one document of each; the open one keeps its fraction."""
    key, held = None, None
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            chunk, place, doc, source, size, whole, part, draw = row
            if (chunk, place) != key:
                if held is not None:
                    out.append(held)
                key, held = (chunk, place), None
            now = [chunk, place, doc, source, size, whole, part, draw]
            if not 0.0 < part < 1.0 or size == 0:
                out.append(now)
            elif held is None:
                held = now
            else:
                held[6], now[6] = _exchange(held[6], part, held[4], size, draw)
                still_open = [r for r in (held, now) if 0.0 < r[6] < 1.0]
                out += [r for r in (held, now) if not 0.0 < r[6] < 1.0]
                held = still_open[0] if still_open else None
        if out:
            yield pd.DataFrame(out, columns=frame.columns)
    if held is not None:
        yield pd.DataFrame([held], columns=["chunk", "place", "row_id", "source", "size", "whole", "part", "draw"])


_SCHEMA = "chunk long, place long, row_id string, source string, size long, whole long, part double, draw double"


def _level(rows: DataFrame, chunks: int) -> DataFrame:
    return (
        rows.repartition(max(1, min(chunks, 4096)), "chunk")
        .sortWithinPartitions("chunk", "place", "draw", "row_id", "size")
        .mapInPandas(_pivot, _SCHEMA)
    )


def mix(docs: DataFrame, chunk_rows: int = CHUNK_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) of every document."""
    with staged_scope(ship(docs.sparkSession)):
        return keep_staged(_mix(docs, chunk_rows, seed))


def _mix(docs: DataFrame, chunk_rows: int, seed: int) -> DataFrame:
    sized = stage(sizes(docs))
    wanted = stage(targets(sized).withColumn("place", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())))
    n = sized.count()
    if not n:
        return sized.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"),
                            F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"))
    chunks = math.ceil(n / chunk_rows)
    share = F.col("target") / F.greatest("source_size", F.lit(1))
    unit = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1 << 40)) / float(1 << 40)
    joined = sized.alias("d").join(wanted.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    rows = joined.select(
        F.pmod(F.xxhash64("d.doc_id", F.lit(seed)), F.lit(chunks)).alias("chunk"), "t.place",
        F.col("d.doc_id").cast("string").alias("row_id"), F.col("d.source").alias("source"), "d.size",
        F.floor(share).alias("whole"), (share - F.floor(share)).alias("part"),
        unit("d.doc_id", "d.size", F.lit(seed + 1)).alias("draw"),
    )
    kind = sized.schema["doc_id"].dataType
    is_open = (F.col("part") > 0) & (F.col("part") < 1) & (F.col("size") > 0)
    done, level = [], 0
    while True:
        rounded = stage(_level(rows, chunks))
        if chunks == 1:
            # What is left of each source is rounded by its own draw.
            last = F.when(unit("row_id", F.lit(seed + 99)) < F.col("part"), 1.0).otherwise(0.0)
            done.append(rounded.withColumn("part", F.when(is_open, last).otherwise(F.col("part"))))
            break
        done.append(rounded.filter(~is_open))
        chunks, level = math.ceil(chunks / FAN_IN), level + 1
        rows = rounded.filter(is_open).select(
            F.floor(F.col("chunk") / FAN_IN).alias("chunk"), "place", "row_id", "source", "size", "whole", "part",
            unit("row_id", F.lit(seed + 1 + level)).alias("draw"),
        )
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionByName(more)
    copies = (F.col("whole") + F.when(F.col("size") > 0, F.round("part")).otherwise(0)).cast("long")
    return decided.alias("d").join(wanted.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        F.col("row_id").cast(kind).alias("doc_id"), F.col("d.source").alias("source"), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
