"""Audit of how filters interact: what each removes, in every order, and what only it would have caught.

Filters.  A to D are judged on a row's text, E (``identical to the text of a smaller id``) on the table.  Bit i of a mask
stands for a failed filter i.

Radix tries.  Every task inserts its texts whole into a compressed trie that holds the smallest id at each terminal.  A
row that is not the smallest there has failed E already and travels on without its text, so a text with millions
of copies leaves a task once per ``TRIE_BYTES`` read.  What is left is dealt by range of text: bounds are the shortest
prefixes that tell neighbouring texts of a sample apart, so they grow long where many texts begin alike.
A range that is still larger than a trie may be (many texts with one long beginning, or fewer bounds than tries) is cut
further by a hash of the whole text.  Each part gets a trie of its own; equal texts always meet, and its terminals tell
which ids are the smallest.  Sample and bounds affect the balance of parts only, never a flag.

Masks.  Rows without texts get their labels by id, after counting equal ones; all figures follow from the number of
rows per part, mask and label: 32 masks per part, whatever the number of rows.

Awkward input.  A null text is empty, a null source is the part ``''``.  A null id is neither smaller nor larger than
any other: such a row never fails E and makes no other row fail it.  Equal ids with equal texts do not fail E against one
another.  Several labels of one id count as marked if one of them is.  An empty table has no parts.  Texts are compared
as bytes; long ones are trie edges of their own.  Further columns are not read.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.llm import textarrays as ta
from alertlift.llm.shipping import ship

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Bytes of texts held by one trie.
TRIE_BYTES = 16 << 20
#: Ranges are bounded by prefixes that are broadcast: no more of them, sampled so often each, looked at so far.
MAX_RANGES, PER_RANGE, LOOK = 4096, 16, 256

_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_ODD = np.zeros(256, dtype=bool)
_ODD[[ord(c) for c in "#$%&*|"]] = True


class RadixTrie:
    """Compressed trie over bytes; each text inserted is a terminal that holds its smallest id."""

    __slots__ = ("edges", "least")

    def __init__(self) -> None:
        # A node is [label, children by first byte, number of its terminal or -1].
        self.edges: list = [b"", {}, -1]
        self.least: list[int] = []

    def insert(self, text: bytes, key: int) -> int:
        """Insert and return the number of the terminal."""
        node, at, n = self.edges, 0, len(text)
        while at < n:
            below = node[1].get(text[at])
            if below is None:
                node[1][text[at]] = below = [text[at:], {}, -1]
                node, at = below, n
                continue
            label = below[0]
            if text.startswith(label, at):
                node, at = below, at + len(label)
                continue
            same = _common(label, text, at)
            split = [label[:same], {label[same]: below}, -1]
            below[0] = label[same:]
            node[1][label[0]] = split
            node, at = split, at + same
        if node[2] < 0:
            node[2] = len(self.least)
            self.least.append(key)
        elif key < self.least[node[2]]:
            self.least[node[2]] = key
        return node[2]


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of ``label`` and ``text[at:]``, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def text_masks(texts: ta.Texts) -> np.ndarray:
    """Bits of the filters A to D."""
    found = ta.words(texts)
    n_words = found.counts()
    hashes = ta.span_hashes(texts.data, found.start, found.end)
    order = np.lexsort((hashes, found.row))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (found.row[order][1:] != found.row[order][:-1])
    distinct = np.bincount(found.row[order][fresh], minlength=texts.n)
    per_row = lambda flags: ta.row_sums(flags, texts.offsets)
    fails = [
        n_words < 200,
        100 * distinct < 50 * n_words,
        100 * per_row(_UPPER[texts.data]) > 2 * per_row(ta.characters(texts.data)),
        per_row(_ODD[texts.data]) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


class _Local:
    """The trie of a task's current stretch of rows, and what is known of them."""

    def __init__(self) -> None:
        self.trie = RadixTrie()
        self.size = 0
        self.terminal: list[int] = []
        self.texts: list[bytes] = []
        self.rows: list[tuple] = []

    def add(self, text: bytes, row: tuple) -> None:
        number = self.trie.insert(text, row[0])
        if number == len(self.texts):
            self.texts.append(text)
            self.size += len(text)
        self.terminal.append(number)
        self.rows.append(row)

    def settled(self) -> tuple[list[tuple], list[tuple[tuple, bytes]]]:
        """Rows whose mask is final, and rows that must meet the rest of the table, with their texts."""
        final, left = [], []
        for row, number in zip(self.rows, self.terminal, strict=True):
            if row[0] > self.trie.least[number]:
                final.append((row[0], row[1], row[2] | DUPLICATE))
            else:
                left.append((row, self.texts[number]))
        return final, left


class _Dealer:
    """Part of a text: its range by prefix, then a shard of that range by hash of the whole text."""

    def __init__(self, bounds: list[bytes], shards: list[int]):
        self.bounds, self.shards = bounds, shards
        self.first = [0, *itertools.accumulate(shards)]

    @property
    def parts(self) -> int:
        return self.first[-1]

    def part(self, text: bytes) -> int:
        i = bisect_right(self.bounds, text)
        m = self.shards[i]
        return self.first[i] + (xxhash.xxh64_intdigest(text) % m if m > 1 else 0)


_SENT = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("mask", pa.int32()), ("part", pa.int32()), ("text", pa.large_binary())])
_DONE = pa.schema(list(_SENT)[:3])
#: Bytes of texts in one batch that goes back to Spark.
_BATCH_BYTES = 2 << 20


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT, strict=True)], schema=_SENT)


def _first_pass(dealer: _Dealer):  # noqa: ANN202
    def flush(held: _Local) -> Iterator[pa.RecordBatch]:
        final, left = held.settled()
        out = [(*row, row[0] % dealer.parts, None) for row in final]
        size = 0
        for row, text in left:
            out.append((*row, dealer.part(text), text))
            size += len(text)
            if size >= _BATCH_BYTES:
                yield _sent(out)
                out, size = [], 0
        if out:
            yield _sent(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Local()
        for batch in batches:
            ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for texts in ta.slices(batch.column(2)):
                masks = text_masks(texts).tolist()
                raw, cuts = texts.data.tobytes(), texts.offsets.tolist()
                loose = []
                for i in range(texts.n):
                    key = ids[texts.first + i]
                    row = (key, sources[texts.first + i], masks[i])
                    if key is None:
                        loose.append((*row, (cuts[i] + i) % dealer.parts, None))
                    else:
                        held.add(raw[cuts[i] : cuts[i + 1]], row)
                if loose:
                    yield _sent(loose)
                if held.size >= TRIE_BYTES or len(held.rows) >= TRIE_BYTES >> 6:
                    yield from flush(held)
                    held = _Local()
        yield from flush(held)

    return run


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: one trie per part."""
    part, held = None, _Local()

    def done(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DONE, strict=True)], schema=_DONE)

    def flush() -> list[tuple]:
        final, left = held.settled()
        return final + [row for row, _ in left]

    for batch in batches:
        ready = batch.filter(pc.is_null(batch.column("text"))).select(_DONE.names)
        if ready.num_rows:
            yield ready
        rest = batch.filter(pc.is_valid(batch.column("text")))
        for key, source, mask, p, text in zip(*(c.to_pylist() for c in rest.columns), strict=True):
            if p != part:
                if held.rows:
                    yield done(flush())
                part, held = p, _Local()
            held.add(text, (key, source, mask))
    if held.rows:
        yield done(flush())


def _separators(sample: list[bytes]) -> list[bytes]:
    """For each sorted sample text after the first, the shortest prefix of it that is above the text before it."""
    out = []
    for a, b in itertools.pairwise(sample):
        out.append(b[: _common(b, a, 0) + 1])
    return out


def deal(docs: DataFrame) -> _Dealer:
    """Bounds and shards for texts of ``docs``: about ``TRIE_BYTES`` of text each."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text) + 64
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    ranges = int(min(MAX_RANGES, max(1, -(-total // TRIE_BYTES))))
    # Rows are sampled by their size, by a hash, so that a rerun draws the same ones.
    u = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.where(u < size * (ranges * PER_RANGE / max(total, 1)))
    sample = sorted(bytes(r[0]) for r in chosen.select(F.substring(F.encode(text, "UTF-8"), 1, LOOK)).collect())
    cuts = _separators(sample)
    step = max(1, len(sample) // ranges)
    bounds = sorted({cuts[i - 1] for i in range(step, len(sample), step)})
    shares = np.bincount([bisect_right(bounds, s) for s in sample], minlength=len(bounds) + 1)
    per_shard = max(1, len(sample) * TRIE_BYTES / max(total, 1))
    return _Dealer(bounds, [max(1, round(s / per_shard)) for s in shares.tolist()])


def failure_masks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``mask`` of every row of ``docs`` (doc_id, source, text)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    dealer = deal(rows)
    first = rows.mapInArrow(_first_pass(dealer), "doc_id long, source string, mask int, part int, text binary")
    met = first.repartition(dealer.parts, "part").sortWithinPartitions("part")
    return met.mapInArrow(_second_pass, "doc_id long, source string, mask int")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: rows, and those labelled as such."""
    part = F.coalesce("source", F.lit(""))
    alike = masks.groupBy("doc_id", part.alias("part"), "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    each = alike.join(marked.where("doc_id is not null"), "doc_id", "left")
    told = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), told("good"), told("toxic"))


def _effects() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All (order, step), and per figure the weight of each mask in it: an array of masks by (order, step)."""
    masks = np.arange(1 << len(FILTERS))
    bits = np.array([bin(m).count("1") for m in masks])
    n_orders = int(np.prod(np.arange(1, len(FILTERS) + 1)))
    # Of all orders, a filter comes before the other failed ones in this many.
    first_of = np.array([n_orders // b if b else 0 for b in bits])
    keys, columns = [], {name: [] for name in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, gone = masks & bit > 0, masks & before > 0
            keys.append(("".join(order), step))
            columns["kept"].append(masks & (before | bit) == 0)
            columns["removed"].append(fails & ~gone)
            columns["redundant"].append(fails & gone)
            columns["unique_fails"].append(masks == bit)
            columns["shapley"].append(np.where(fails, first_of, 0))
            before |= bit
    return keys, {name: np.array(c, dtype=np.int64).T for name, c in columns.items()}


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES)


def _expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keys, effect = _effects()
    orders, steps = [k[0] for k in keys], np.array([k[1] for k in keys], dtype=np.int32)
    for frame in frames:
        for row in frame.itertuples(index=False):
            n, good, toxic = (np.asarray(c, dtype=np.int64) for c in (row.n, row.good, row.toxic))
            figures = {name: n @ effect[name] for name in ("kept", "removed", "redundant", "unique_fails", "shapley")}
            figures |= {"good_lost": good @ effect["removed"], "toxic_lost": toxic @ effect["removed"]}
            yield pd.DataFrame({"part": row.part, "filter_order": orders, "step": steps, **{f: figures[f] for f in FIGURES}})


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of filters and step, from the counts of masks."""
    ship(counts.sparkSession)
    vector = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(1 << len(FILTERS))])
    wide = counts.groupBy("part").agg(vector("n").alias("n"), vector("good").alias("good"), vector("toxic").alias("toxic"))
    return wide.mapInPandas(_expand, _AUDIT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return interactions(mask_counts(failure_masks(docs), labels))


ORACLE = r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as body from documents),
w as (select *, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  min(doc_id) over (partition by body) as first_id from t),
m as (select doc_id, part,
  cast(len(words) < 200 as int) + 2 * cast(100 * len(list_distinct(words)) < 50 * len(words) as int)
  + 4 * cast(100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) as int)
  + 8 * cast(regexp_matches(body, '[#$%&*|]') as int) + 16 * coalesce(cast(doc_id > first_id as int), 0) as mask from w),
g as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from m left join g using (doc_id) group by part, mask),
f(name, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31
  and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s as (select filter_order, i as step, bits[i] as bit, cast(coalesce(list_sum(bits[1:i - 1]), 0) as int) as before
  from o, (values (1), (2), (3), (4), (5)) as steps(i)),
p as (select part, filter_order, step, s.bit,
  cast(sum(n) filter (where mask & (s.before | s.bit) = 0) as bigint) as kept,
  cast(sum(n) filter (where mask & s.bit > 0 and mask & s.before = 0) as bigint) as removed,
  cast(sum(n) filter (where mask & s.bit > 0 and mask & s.before > 0) as bigint) as redundant,
  cast(sum(n) filter (where mask = s.bit) as bigint) as unique_fails,
  cast(sum(good) filter (where mask & s.bit > 0 and mask & s.before = 0) as bigint) as good_lost,
  cast(sum(toxic) filter (where mask & s.bit > 0 and mask & s.before = 0) as bigint) as toxic_lost
  from s, c group by all)
select part, filter_order, cast(step as int) as step, coalesce(kept, 0) as kept, coalesce(removed, 0) as removed,
  coalesce(redundant, 0) as redundant, coalesce(unique_fails, 0) as unique_fails, coalesce(good_lost, 0) as good_lost,
  coalesce(toxic_lost, 0) as toxic_lost, cast(coalesce(sum(removed) over (partition by part, bit), 0) as bigint) as shapley
from p
"""
