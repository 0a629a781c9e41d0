"""Exact Jaccard self-join of word n-gram sets with set-relation skipping (operator 3).

1. One pass over the texts gives each document the size and a 128-bit fingerprint of its set of shingle hashes,
   and adds up a fixed-size count sketch of all shingles.  Documents with equal sets are one class.
2. A second pass orders each class's set by (sketch count, hash), rare first, and posts its prefix: two sets that
   link share a token there.  The sketch only decides the order, which may be any; it cannot lose a link.
3. Lists with one entry are dropped.  In each list the smallest id of a size band is the band's leader; leaders are
   compared with their band by whole sets.  Linked sets are merged into components.
4. All sets compared with one leader meet under the least of their leaders, their home.  Each is written down as what it lacks
   of and has beyond the leader's set.  Classes of a home are dealt to blocks of bounded size; for two blocks, bounds from the
   leader's answers settle most pairs, with o(u) = |leader & u|:
   o(u) + o(v) - |leader| <= |u & v| <= min(o(u), o(v)) + min(|u| - o(u), |v| - o(v)),
   and the others follow from the differences alone: |u & v| = |leader| - lacks(u) - lacks(v) + |lacks(u) & lacks(v)| +
   |beyond(u) & beyond(v)|.  Only edges that span what is linked are written, fewer than classes.
5. Skipping.  A list whose entries are in one component by now is done.  Other lists are cut into blocks of about
   ``BLOCK`` entries; block pairs are skipped by size band, by position (too little of both sets is left behind
   the token) and by component, pairs of entries also by home and by the bounds; the few left are compared by whole sets.
6. Links are counted in the same way within components, where all of them lie, under the class that names the component: a
   block pair gives one number per class; no pair of documents is ever written.

Components are those of all links: a pair is left out only when it cannot link or is already connected.

A third of all rows may be copies of one text: they are one class, found by an aggregation with partial sums.  A
list may be very long: bands, counts and leaders are partial aggregates and blocks have a bounded size.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; a text with
fewer words than the shingle width has its whole sequence as one shingle; repeated rows link like copies.  Classes are told
apart by their sets alone: a row without doc_id links like any other, and one doc_id with two texts stands in two classes
and joins neither; a component bears its smallest doc_id, null if it has none.  Texts are read whole.  An empty table gives
no rows.  Only doc_id and text are read, so extra columns cannot clash.  Shingles are compared by 64-bit hashes, and a class
is known by 64 bits of its fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.llm import textarrays as ta
from alertlift.llm.components import components
from alertlift.llm.shipping import ship
from alertlift.sources.staging import keep_staged, stage, staged_scope

#: Shingle width, and the least similarity as a fraction, where a contract says nothing else.
WIDTH, AT_LEAST = 5, (80, 100)

#: Counters of the sketch and of one of its stored blocks; bits of the id filter.
SKETCH, SKETCH_BLOCK = 1 << 20, 1 << 14
FILTER_BITS = 1 << 23
#: Entries of a list block, on average.
BLOCK = 256
#: Classes and bytes of differences of one block in which links are counted; tokens looked at at once there.
COUNTED, COUNTED_BYTES, COUNTED_TOKENS = 512, 4 << 20, 4096

_SEEDS = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], dtype=np.uint64)


def shingle_sets(texts: ta.Texts, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text, A-Z lower-cased."""
    lowered = texts.lowered()
    found = ta.words(lowered)
    hashes = ta.span_hashes(lowered.data, found.start, found.end)
    windows, first = ta.window_hashes(hashes, found, width)
    counts, before = found.counts(), found.before
    cuts = np.searchsorted(first, before)
    out = []
    for i in range(texts.n):
        if counts[i] >= width:
            out.append(np.unique(windows[cuts[i] : cuts[i + 1]]))
        elif counts[i]:
            own = hashes[before[i] : before[i + 1]]
            n = len(own)
            out.append(ta.mix(np.array([(own * ta.FACTORS[:n]).sum() + np.uint64(n)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _summaries(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents (block null) and, at the end of the task, of its part of the sketch (size null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, dtype=np.int64)
        names = ["doc_id", "size", "fp1", "fp2", "block", "counts"]
        kind = pa.int64()
        for batch in batches:
            kind, held = batch.schema.field(0).type, []
            for texts in ta.slices(batch.column(1)):
                sets = shingle_sets(texts, width)
                held.append((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.uint32))
                prints = np.array([[ta.mix(s ^ seed).sum() for seed in _SEEDS] for s in sets], dtype=np.uint64).reshape(-1, 2)
                ids = batch.column(0).slice(texts.first, texts.n)
                none = lambda t, n=texts.n: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), *(pa.array(p.view(np.int64)) for p in prints.T.copy()),
                     none(pa.int32()), none(pa.binary())], names)
            if held:
                sketch += np.bincount(np.concatenate(held), minlength=SKETCH)
        if sketch.any():
            parts = sketch.astype("<i8").reshape(-1, SKETCH_BLOCK)
            none = lambda t: pa.nulls(len(parts), t)
            yield pa.RecordBatch.from_arrays(
                [none(kind), none(pa.int64()), none(pa.int64()), none(pa.int64()),
                 pa.array(np.arange(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names)

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums by block; what is held does not grow with the rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(counts, "<i8")
            sums[block] = sums[block] + part if block in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())],
            ["block", "counts"],
        )


def _sketch(parts: DataFrame) -> np.ndarray:
    """The whole sketch on the driver: SKETCH counters, whatever the corpus."""
    added = parts.repartition(SKETCH // SKETCH_BLOCK, "block").mapInArrow(_add_blocks, "block int, counts binary")
    whole = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), dtype=np.int64)
    for row in added.collect():
        whole[row["block"]] += np.frombuffer(row["counts"], "<i8")
    return whole.reshape(-1)


def _has(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits // 32] >> (bits % 32).astype(np.uint32)) & 1 == 1


def _prefixes(width: int, at_least: tuple[int, int], sketch, several, stand) -> Callable:  # noqa: ANN001  broadcasts
    """Rows (bit of doc_id, text) to prefixes of classes.  ``several``: filter of the classes that may have more than one row,
    ``stand``: of the rows that stand for those.  Most copies are dropped, no class is; the few left post what theirs does."""
    num, den = at_least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sketch.value
        for batch in batches:
            for texts in ta.slices(batch.column(1)):
                sets = shingle_sets(texts, width)
                prints = np.array([ta.mix(s ^ _SEEDS[0]).sum() for s in sets], dtype=np.uint64)
                rows = batch.column(0).slice(texts.first, texts.n).to_numpy()
                copy = _has(several.value, (prints & np.uint64(FILTER_BITS - 1)).astype(np.int64)) & ~_has(stand.value, rows)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                posts = np.flatnonzero(~copy & (size > 0))
                out = [np.empty(0, dtype=np.int64)]
                for i in posts.tolist():
                    own = sets[i]
                    length = len(own) - (num * len(own) + den - 1) // den + 1
                    # ``own`` is sorted by hash already, and a stable sort by count keeps that order among equals.
                    order = np.argsort(common[(own & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")[:length]
                    out.append(own[order].view(np.int64))
                offsets = np.cumsum([len(x) for x in out])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints.view(np.int64)[posts]), pa.array(size[posts]),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out)))],
                    ["id", "size", "prefix"])

    return run


def _in_filter(bitmap) -> Callable:  # noqa: ANN001  a broadcast
    """Rows whose first column, a bit, is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_has(bitmap.value, batch.column(0).to_numpy())))

    return run


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with a bit for each hashed id: fixed size, no false negatives."""
    return bit_filter(ids.select(F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER_BITS)).alias("bit")))


def bit_filter(bits: DataFrame) -> np.ndarray:
    by_word = bits.select(F.expr("cast(bit div 32 as int)").alias("word"), F.expr("shiftleft(1L, cast(bit % 32 as int))").alias("b"))
    bitmap = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for batch in by_word.groupBy("word").agg(F.bit_or("b").alias("b")).toArrow().to_batches():
        bitmap[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    return bitmap


def _sets_of(width: int, bitmap) -> Callable:  # noqa: ANN001  a broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_has(bitmap.value, batch.column(1).to_numpy())))
            for texts in ta.slices(kept.column(0)):
                sets = shingle_sets(texts, width)
                prints = np.array([ta.mix(s ^ _SEEDS[0]).sum() for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["id", "set"]
                )

    return run


def _by_doc(column: str) -> Column:
    """Ids of rows as the filter sees them; rows without one share one."""
    return F.coalesce(F.col(column), F.lit(-(1 << 63)).cast("long"))


def _bit_of_doc(column: str) -> Column:
    return F.pmod(F.xxhash64(_by_doc(column)), F.lit(FILTER_BITS))


def posted_prefixes(docs: DataFrame, classes: DataFrame, width: int, at_least: tuple[int, int], sketch) -> DataFrame:  # noqa: ANN001
    """(id, size, pos, token) of the prefix of every class, for a few copies more than once.

    Which row stands for a class is told by fixed-size filters where texts are read: no prefix is shuffled to find it.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast
    bit = F.pmod("fp1", F.lit(FILTER_BITS)).alias("bit")
    several = broadcast(bit_filter(classes.filter("n_rows > 1").select(bit)))
    # A class of one row whose bit is there as well needs its row in the second filter.
    stand = classes.select(bit, _bit_of_doc("rep").alias("row")).mapInArrow(_in_filter(several), "bit long, row long")
    stand = broadcast(bit_filter(stand.select(F.col("row").alias("bit"))))
    prefixes = docs.select(_bit_of_doc("doc_id").alias("bit"), "text").mapInArrow(
        _prefixes(width, at_least, sketch, several, stand), "id long, size long, prefix array<long>"
    )
    return prefixes.select("id", "size", F.posexplode("prefix").alias("pos", "token"))


def sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """All columns of ``ids``, one row per class, and its set.

    A fixed-size bitmap of the rows that stand for them drops the other texts where they are read, so only sets that
    take part are shuffled.
    """
    spark = docs.sparkSession
    wanted = classes.join(ids, "id", "left_semi").select(_by_doc("rep").alias("rep"))
    bitmap = spark.sparkContext.broadcast(id_filter(wanted))
    # Rows of one class by the row that stands for it: copies under other ids do not pass.
    sets = docs.select("text", _bit_of_doc("doc_id").alias("bit")).mapInArrow(_sets_of(width, bitmap), "id long, set binary")
    return sets.join(ids.hint("merge"), "id").groupBy(*ids.columns).agg(F.first("set").alias("set"))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        overlap = np.zeros(batch.num_rows, dtype=np.int64)
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in (2, 3))
            if len(x) > len(y):
                x, y = y, x
            if len(x):
                at = np.searchsorted(y, x)
                overlap[i] = (y[np.minimum(at, len(y) - 1)] == x).sum()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(overlap)], ["a", "b", "overlap"])


def sets_in(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(id, set) of all classes in ``pairs``; staged."""
    ids = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    return stage(sets_of(docs, classes, ids, width))


def whole_overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, overlap) of the distinct pairs (a, b) of classes, by the whole sets of both; staged."""
    first = pairs.hint("merge").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = first.hint("merge").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    out = both.select("a", "b", "set_a", "set_b").mapInArrow(_overlaps, "a long, b long, overlap long")
    return stage(out.groupBy("a", "b").agg(F.max("overlap").alias("overlap")))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comp, id, n_rows, alone, set, set of the leader) to what the set lacks of the leader's and has beyond it; a class that is
    ``alone`` in its group meets no other, so its overlap with the leader is all that is told."""
    for batch in batches:
        lacks, beyond, size, led, overlap = [], [], [], [], []
        for i, alone in enumerate(batch.column(3).to_pylist()):
            own, leader = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in (4, 5))
            lacking = np.setdiff1d(leader, own, assume_unique=True)
            lacks.append(b"" if alone else lacking.tobytes())
            beyond.append(b"" if alone else np.setdiff1d(own, leader, assume_unique=True).tobytes())
            size.append(len(own))
            led.append(len(leader))
            overlap.append(len(leader) - len(lacking))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in range(4)), *(pa.array(n, pa.int64()) for n in (size, led, overlap)),
             pa.array(lacks, pa.binary()), pa.array(beyond, pa.binary())],
            ["comp", "id", "n_rows", "alone", "size", "led", "overlap", "lacks", "beyond"],
        )


@dataclass
class _Classes:
    """Classes of one block: their differences from the leader as flat arrays."""

    id: np.ndarray
    n_rows: np.ndarray
    size: np.ndarray
    led: int
    lacks: list[np.ndarray]
    beyond: list[np.ndarray]

    @staticmethod
    def of(value: pa.Scalar) -> _Classes:
        flat = value.values
        whole = lambda f: flat.field(f).to_numpy(zero_copy_only=False)
        parts = lambda f: [np.frombuffer(v.as_buffer(), "<u8") for v in flat.field(f)]
        return _Classes(whole("id"), whole("n_rows"), whole("size"), int(whole("led")[0]), parts("lacks"), parts("beyond"))


def _common_counts(a: list[np.ndarray], b: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """|x & y| for x in the chosen ``rows`` of ``a`` and y in the chosen ``columns`` of ``b``."""
    flat = lambda sets, which: np.concatenate([np.empty(0, "<u8"), *(sets[i] for i in which)])
    owner = lambda sets, which: np.repeat(np.arange(len(which)), [len(sets[i]) for i in which])
    x, y, of_x, of_y = flat(a, rows), flat(b, columns), owner(a, rows), owner(b, columns)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(rows), len(columns)))
    for start in range(0, len(shared), COUNTED_TOKENS):
        some = shared[start : start + COUNTED_TOKENS]
        sides = []
        for tokens, of, n in ((x, of_x, len(rows)), (y, of_y, len(columns))):
            at = np.minimum(np.searchsorted(some, tokens), len(some) - 1)
            hit = some[at] == tokens
            member = np.zeros((n, len(some)), dtype=np.float32)
            member[of[hit], at[hit]] = 1
            sides.append(member)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def links_between(a: _Classes, b: _Classes, at_least: tuple[int, int]) -> np.ndarray:
    """Which classes of ``a`` link with which of ``b``, from their common leader's answers and their differences."""
    num, den = at_least
    count = lambda sets: np.array([len(s) for s in sets], dtype=np.int64)
    la, lb, ea, eb = (count(s) for s in (a.lacks, b.lacks, a.beyond, b.beyond))
    need = num * (a.size[:, None] + b.size[None, :])
    low = (a.led - la)[:, None] - lb[None, :]
    most = np.minimum((a.led - la)[:, None], (a.led - lb)[None, :]) + np.minimum(ea[:, None], eb[None, :])
    linked = (den + num) * np.maximum(low, 0) >= need
    open_ = ~linked & ((den + num) * most >= need)
    rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if len(rows):
        box = np.ix_(rows, columns)
        overlap = low[box] + _common_counts(a.lacks, b.lacks, rows, columns) + _common_counts(a.beyond, b.beyond, rows, columns)
        linked[box] |= (den + num) * overlap >= need[box]
    return linked


def _count_links(at_least: tuple[int, int]) -> Callable:
    """Rows (first, second block of a component; null where it is the same) to each class's number of linked rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blocks = [_Classes.of(v) for v in batch.column(0)[i].values.field("e")]
                a, b = blocks[0], blocks[-1]
                linked = links_between(a, b, at_least)
                if len(blocks) == 1:
                    np.fill_diagonal(linked, False)
                    told = [(a.id, linked @ a.n_rows)]
                else:
                    told = [(a.id, linked @ b.n_rows), (b.id, linked.T @ a.n_rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), pa.int64()) for c in zip(*told, strict=True)], ["id", "far"]
                )

    return run


def _spanning(at_least: tuple[int, int]) -> Callable:
    """Rows of one or two blocks to edges that connect what their links connect: fewer than classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blocks = [_Classes.of(v) for v in batch.column(0)[i].values.field("e")]
                a, b = blocks[0], blocks[-1]
                linked, n = links_between(a, b, at_least), len(a.id)
                ids, near = a.id, linked
                if len(blocks) == 2:
                    ids = np.concatenate([a.id, b.id])
                    near = np.zeros((len(ids), len(ids)), dtype=bool)
                    near[:n, n:], near[n:, :n] = linked, linked.T
                label, before = np.arange(len(ids)), None
                while before is None or (label != before).any():
                    before = label
                    label = np.minimum(label, np.where(near, label[None, :], len(ids)).min(axis=1, initial=len(ids)))
                    label = label[label]
                held = np.flatnonzero(label != np.arange(len(ids)))
                x, y = ids[held], ids[label[held]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], ["a", "b"])

    return run


def differences(members: DataFrame) -> DataFrame:
    """comp (a group), id, n_rows, alone, and each set by its differences from ``leader``, a set near to all of the group; staged."""
    told = "comp long, id long, n_rows long, alone boolean, size long, led long, overlap long, lacks binary, beyond binary"
    return stage(members.select("comp", "id", "n_rows", "alone", "set", "leader").mapInArrow(_differences, told))


def block_pairs_of(different: DataFrame) -> DataFrame:
    """Blocks of classes to compare with one another: one row per pair of blocks of a group, and one per block."""
    weight = F.octet_length("lacks") + F.octet_length("beyond")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / COUNTED, F.sum(weight.cast("long")) / COUNTED_BYTES, F.lit(1)))
    dealt = different.groupBy("comp").agg(blocks.cast("int").alias("n"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    entry = F.struct("id", "n_rows", "size", "led", "lacks", "beyond")
    block = (
        different.join(dealt, "comp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
        .groupBy("comp", "n", "block").agg(F.collect_list(entry).alias("e"))
    )
    only = block.filter("n = 1").select(F.array(F.struct("block", "e")).alias("blocks"))
    # Every block goes to each of its pairs: one row per pair, wherever its group is.
    met = block.filter("n > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = met.groupBy("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(
        F.collect_list(F.struct("block", "e")).alias("blocks")
    )
    return only.union(pairs.filter(F.size("blocks") == F.when(F.col("i") == F.col("j"), 1).otherwise(2)).select("blocks"))


def link_counts(docs: DataFrame, classes: DataFrame, merged: DataFrame, width: int, at_least: tuple[int, int]) -> DataFrame:
    """(id, far) of the classes in ``merged`` (node, component_id): how many rows of other classes link with each."""
    members = classes.join(merged.select(F.col("node").alias("id"), F.col("component_id").alias("comp")), "id").select("id", "n_rows", "comp")
    with staged_scope(docs.sparkSession):
        sets = stage(sets_of(docs, classes, members, width))
        # The class that names a component leads it.
        leaders = sets.filter("id = comp").select("comp", F.col("set").alias("leader"))
        own = sets.withColumn("alone", F.lit(False))
        counted = block_pairs_of(differences(own.hint("merge").join(leaders, "comp"))).mapInArrow(_count_links(at_least), "id long, far long")
        return keep_staged(counted.groupBy("id").agg(F.sum("far").alias("far")))


def roles(homes: DataFrame, apart: DataFrame) -> DataFrame:
    """What each set of the classes is read for, known before any is: id, home and whether it is alone there, ``leads`` (it is a
    home), ``whole`` (it is in a pair of ``apart``); staged.  So each use shuffles the sets that it needs and no other."""
    held = homes.groupBy("home").agg((F.count(F.lit(1)) == 1).alias("alone"))
    no_home, no = [F.lit(None).cast("long").alias("home"), F.lit(None).cast("boolean").alias("alone")], F.lit(False)
    sides = apart.select(F.col("a").alias("id")).union(apart.select("b"))
    return stage(
        homes.join(held, "home").select("id", "home", "alone", no.alias("leads"), no.alias("whole"))
        .union(held.select(F.col("home").alias("id"), *no_home, F.lit(True), no))
        .union(sides.select("id", *no_home, no, F.lit(True)))
        .groupBy("id").agg(*[F.max(c).alias(c) for c in ("home", "alone", "leads", "whole")])
    )


def at_home(sets: DataFrame) -> DataFrame:
    """Differences of classes from their home's set; ``sets``: those of ``roles``."""
    one = F.lit(1).cast("long").alias("n_rows")
    own = sets.filter("home is not null").select(F.col("home").alias("comp"), "id", one, "alone", "set")
    leaders = sets.filter("leads").select(F.col("id").alias("comp"), F.col("set").alias("leader"))
    return differences(own.hint("merge").join(leaders, "comp"))


def _linked(overlap: Column, size_a: Column, size_b: Column, at_least: tuple[int, int]) -> Column:
    num, den = at_least
    return (den + num) * overlap >= num * (size_a + size_b)


@dataclass
class Joined:
    """rows: doc_id, n_shingles, class_id (smallest doc_id with that set), component_id, where links are counted also n_links
    (the rows that the row links with, copies included).  links: a < b, keys of classes, pairs that connect all components.
    """

    rows: DataFrame
    links: DataFrame


def _block_pairs(at_least: tuple[int, int], kind: pa.DataType) -> Callable:
    """Pairs of entries of two blocks (or of one with itself) that the filters and the leaders' answers leave open; pairs of
    one component or of one home are left out."""
    num, den = at_least
    fields = ("id", "size", "pos", "comp", "leader", "o", "home")

    def entries(column: pa.Array, i: int) -> list[np.ndarray]:
        flat = column[i].values
        return [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for i in range(batch.num_rows):
                same = batch.column(0)[i].as_py()
                a = entries(batch.column(1), i)
                b = a if same else entries(batch.column(2), i)
                (ia, sa, pa_, ca, la, oa, ha), (ib, sb, pb, cb, lb, ob, hb) = [[x[:, None] for x in a], [x[None, :] for x in b]]
                need = num * (sa + sb)
                open_ = (ca != cb) & (ha != hb) & (ia != ib)
                if same:
                    open_ &= ia < ib
                open_ &= (den + num) * np.minimum(sa - pa_, sb - pb) >= need
                # Answers derived from a leader that both were compared with; o is -1 where there is none.
                known = (la == lb) & (oa >= 0) & (ob >= 0)
                most = np.minimum(oa, ob) + np.minimum(sa - oa, sb - ob)
                open_ &= ~known | ((den + num) * most >= need)
                x, y = np.nonzero(open_)
                if len(x):
                    found.append(np.stack([ia[x, 0], ib[0, y]]))
            if found:
                pairs = np.concatenate(found, axis=1)
                distinct = np.unique(np.stack([pairs.min(axis=0), pairs.max(axis=0)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(distinct[:, 0]).cast(kind), pa.array(distinct[:, 1]).cast(kind)], ["a", "b"])

    return run


def jaccard_join(
    docs: DataFrame, width: int = WIDTH, at_least: tuple[int, int] = AT_LEAST, block: int = BLOCK, all_links: bool = False
) -> Joined:
    """Components of documents whose shingle sets have Jaccard similarity >= at_least[0] / at_least[1].  doc_id: a whole number.

    The result is staged; all tables on the way to it are deleted.
    """
    with staged_scope(ship(docs.sparkSession)):
        found = _join(docs, width, at_least, block, all_links)
        return Joined(keep_staged(found.rows), keep_staged(found.links))


def _join(docs: DataFrame, width: int, at_least: tuple[int, int], block: int, all_links: bool) -> Joined:
    spark = docs.sparkSession
    num, den = at_least
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = stage(
        docs.mapInArrow(_summaries(width), "doc_id long, size long, fp1 long, fp2 long, block int, counts binary")
    )
    rows = summary.filter("block is null").select("doc_id", "size", "fp1", "fp2")
    classes = stage(
        rows.filter("size > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("id", F.col("fp1"))
    )
    sketch = spark.sparkContext.broadcast(_sketch(summary.filter("block is not null").select("block", "counts")))

    posted = posted_prefixes(docs, classes, width, at_least, sketch)
    # Sets that link lie in the same or in neighbouring bands (a little wider, so that rounding cannot matter).
    band = F.floor(F.log("size") / float(np.log(den / num) * (1 + 1e-9))).alias("band")
    live = stage(_shared_tokens(posted).select("token", "id", "size", "pos", band))

    # Leaders of the bands of each list, compared with all entries that pass the size and position filters.
    bands = live.groupBy("token", "band").agg(F.min(F.struct("id", "size", "pos")).alias("lead"), F.count(F.lit(1)).alias("n"))
    led = live.join(bands, ["token", "band"])
    rest = F.least(F.col("size") - F.col("pos"), F.col("lead.size") - F.col("lead.pos"))
    starred = led.filter(F.col("id") != F.col("lead.id")).filter(_linked(rest, F.col("size"), F.col("lead.size"), at_least))
    pairs = starred.select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()
    pairs = stage(pairs)
    # The least leader of a class is its home.  Classes of one home meet there, by their differences to it, which also tell how
    # they overlap with the home itself; only pairs of two homes are compared by whole sets.
    homes = stage(pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("home")))
    home_of = lambda side: homes.select(F.col("id").alias(side), F.col("home").alias(f"home_{side}"))
    size_of = lambda side: classes.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"))
    linked = lambda found: found.join(size_of("a"), "a").join(size_of("b"), "b").filter(
        _linked(F.col("overlap"), F.col("size_a"), F.col("size_b"), at_least)
    ).select("a", "b")
    # What a scope stages, sets above all, goes as soon as its answers are there.
    with staged_scope(spark):
        apart = pairs.join(home_of("b"), "b").join(home_of("a"), "a", "left").filter("a != home_b and home_b != coalesce(home_a, a)")
        apart = stage(apart.select("a", "b"))
        sets = stage(sets_of(docs, classes, roles(homes, apart), width))
        different = at_home(sets)
        near_home = different.select(F.col("comp").alias("a"), F.col("id").alias("b"), "overlap")
        compared = keep_staged(near_home.union(whole_overlaps(apart, sets.filter("whole"))))
        at_homes = block_pairs_of(different.filter("not alone")).mapInArrow(_spanning(at_least), "a long, b long")
        links = keep_staged(linked(compared).union(at_homes).distinct())
    merged = stage(components(links))

    # Blocks of the lists that are not in one component yet.
    label = live.join(merged.withColumnRenamed("node", "id"), "id", "left").join(homes, "id", "left")
    label = label.withColumns({"comp": F.coalesce("component_id", "id"), "home": F.coalesce("home", "id")})
    mixed = label.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token")
    label = label.join(mixed, "token", "left_semi")
    entries = (
        label.join(bands.select("token", "band", F.col("lead.id").alias("leader"), "n"), ["token", "band"])
        .join(compared.select(F.col("a").alias("leader"), F.col("b").alias("id"), "overlap"), ["leader", "id"], "left")
        .withColumn("o", F.when(F.col("leader") == F.col("id"), F.col("size")).otherwise(F.coalesce("overlap", F.lit(-1))))
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)))
    )
    size = F.col("size")
    blocks = stage(
        entries.groupBy("token", "band", "salt").agg(
            F.collect_list(F.struct("id", "size", F.col("pos").cast("long").alias("pos"), "comp", "leader", "o", "home")).alias("e"),
            F.min(size).alias("small"), F.max(size - F.col("pos")).alias("rest"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        )
    )
    a, b = blocks.alias("a"), blocks.alias("b")
    later = (F.col("b.band") == F.col("a.band") + 1) | ((F.col("b.band") == F.col("a.band")) & (F.col("b.salt") > F.col("a.salt")))
    one = (F.col("a.low") == F.col("b.low")) & (F.col("a.low") == F.col("a.high")) & (F.col("b.low") == F.col("b.high"))
    reach = _linked(F.least("a.rest", "b.rest"), F.col("a.small"), F.col("b.small"), at_least)
    across = a.join(b, (F.col("a.token") == F.col("b.token")) & later & ~one & reach).select(F.lit(False).alias("same"), F.col("a.e").alias("x"), F.col("b.e").alias("y"))
    within = blocks.filter("low < high").select(F.lit(True).alias("same"), F.col("e").alias("x"), F.lit(None).cast(blocks.schema["e"].dataType).alias("y"))
    more = within.union(across).mapInArrow(_block_pairs(at_least, pa.int64()), "a long, b long")
    late = stage(more.distinct().join(compared, ["a", "b"], "left_anti"))
    with staged_scope(spark):
        links = keep_staged(links.union(linked(whole_overlaps(late, sets_in(docs, classes, late, width)))).distinct())

    final = stage(components(links))
    labelled = classes.join(final.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component_id", "id"))
    least = labelled.filter("component_id is not null").groupBy("comp").agg(F.min("rep").alias("least"))
    of_class = labelled.join(least, "comp", "left").select(
        "fp1", "fp2", "id", "n_rows", F.col("rep").alias("class_id"),
        F.when(F.col("component_id").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"),
    )
    linked_rows: list[Column] = []
    if all_links:
        far = link_counts(docs, classes, final, width, at_least)
        of_class = of_class.join(far, "id", "left").withColumn("n_links", F.col("n_rows") - 1 + F.coalesce("far", F.lit(0)))
        linked_rows = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    of_class = of_class.drop("id", "n_rows")
    out = rows.join(of_class, ["fp1", "fp2"], "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *linked_rows,
    )
    return Joined(out, links)


def _shared_tokens(posted: DataFrame) -> DataFrame:
    """Postings of tokens that two or more classes post, each once; lists pass by in order and are not held."""
    return posted.repartition("token").sortWithinPartitions("token", "id").mapInArrow(_drop_single, posted.schema)


def _drop_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and id, one each, those whose neighbour has the same token.  The last row waits for the next batch."""
    held, before = None, None  # the row that waits, and the token before it
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch]) if held is not None else pa.Table.from_batches([batch])
        token, ids = table.column("token").to_numpy(), table.column("id").to_numpy()
        again = (token[1:] == token[:-1]) & (ids[1:] == ids[:-1])
        if again.any():
            # Rows of copies are equal, so any of them may go.
            first = np.concatenate([[True], ~again])
            table, token = table.filter(pa.array(first)), token[first]
        equal = token[1:] == token[:-1]
        left = np.concatenate([[before is not None and before == token[0]], equal])
        keep = left[:-1] | equal
        yield from table.slice(0, len(token) - 1).filter(pa.array(keep)).combine_chunks().to_batches()
        held = table.slice(len(token) - 1).combine_chunks().to_batches()[0]
        before = token[-1] if left[-1] else None
    if held is not None and before is not None:
        yield held


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = jaccard_join(docs, width=4, at_least=(85, 100), all_links=True).rows
    return found.select("doc_id", "n_shingles", "component_id", "n_links")
