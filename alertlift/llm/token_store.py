"""Token ids in binary shards compressed by Re-Pair grammars (operator 2).

Texts are encoded by the tokenizers library and ordered by doc_id.  Consecutive documents make a shard of about
``SHARD_IDS`` ids.  Re-Pair replaces frequent pairs of neighbouring ids by nonterminals, again and again; here each
round replaces all pairs that occur often enough at once, at places that don't overlap.  It ends when no pair has
``LEAST`` such places left.

One row of the store is a shard:

    part, shard      order of the shard (parts are ranges of doc_id)
    doc_ids          ids of its documents, ascending
    lengths          number of ids of each document (unsigned 32-bit, little-endian, as all arrays below)
    rules            pairs (left, right); rule i defines nonterminal FIRST_RULE + i
    expansions       number of ids that each rule stands for
    sequence         what is left of the ids
    n_ids            number of ids

``expansions`` give every symbol's length, so a range of ids is decoded by expanding the symbols that cover it.
Spark writes the store as Parquet into the shared folder, so a lost executor costs a task, never a file.

Defined results: a null text counts as empty and holds its end id alone; texts count whole (a text longer than a shard
is a shard); rows without doc_id come first; repeated ids keep all their rows, in any order among them; an empty table
gives an empty store.  Only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlift.llm import textarrays as ta
from alertlift.llm.bpe_trie import PATTERN, byte_characters, public_path
from alertlift.llm.chunks import SETTLED, ChunkTable, Kept, gather
from alertlift.llm.shipping import ship
from alertlift.sources.staging import scratch_path

SHARD_IDS = 1 << 20
END_ID = 2
#: Nonterminals begin here; ids of the vocabulary are smaller.
FIRST_RULE = 1 << 16
#: A rule takes three numbers and saves one at each place, so it pays from four places on.
LEAST = 4
#: Bytes of text that one part of the ordered table holds, about.
PART_BYTES = 24 << 20
#: Bytes of text that are encoded at once: words that they share are looked up once.
SLICE_BYTES = 1 << 20

_SLOTS = 1 << 17
_WORST = np.iinfo(np.int32).max
_tables: dict[str, ChunkTable] = {}


def _library(path: str) -> ChunkTable:
    """Chunks encoded by the tokenizers library, kept by the worker process."""
    if path not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Library(Tokenizer.from_file(path))
        _tables[path] = ChunkTable(library.encode_words, library.encode_all, library.added, ordered=False)
    return _tables[path]


class Library:
    """Encodes by the tokenizers library: distinct words by its model alone, whatever holds an added token as a whole.

    Its ids are the library's own; its batch call would spend most of its time on offsets and on words seen before.
    """

    def __init__(self, tokenizer) -> None:  # noqa: ANN001  a tokenizers.Tokenizer
        self.tokenizer, self.model, self.words = tokenizer, tokenizer.model, Kept()
        self.letters = {b: c for c, b in byte_characters().items()}
        self.pattern = regex.compile(PATTERN)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of the pattern, given as UTF-8."""
        tokenize = self.model.tokenize
        # One character a byte, before and after translation, so words are cut out again by their lengths.
        letters = b"".join(words).decode("latin-1").translate(self.letters)
        ends = list(itertools.accumulate(map(len, words)))
        found = [[t.id for t in tokenize(letters[a:b])] for a, b in zip([0, *ends], ends, strict=False)]
        raw = np.fromiter(itertools.chain.from_iterable(found), "<u4").tobytes()
        ends = list(itertools.accumulate(4 * len(x) for x in found))
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split: list[list[str] | None] = []
        for text in texts:
            if any(map(text.__contains__, self.added)):
                split.append(None)
            elif text.isascii() or ord(max(text)) < SETTLED:
                split.append(self.pattern.findall(text))
            else:
                split.append([text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)])
        new = self.words.lacking({w for s in split if s for w in s})
        self.words.new.update(zip(new, self.encode_words([w.encode("utf-8") for w in new]), strict=True))
        known = self.words.new.__getitem__
        return [self._whole(t) if s is None else b"".join(map(known, s)) for t, s in zip(texts, split, strict=True)]

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def compress(ids: np.ndarray, rounds: int | None = None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansions, sequence) of one shard.

    A pair's places are taken where its rank is better than the pair before and not worse than the pair after, so
    no two overlap.  What loses out is found again in the next round; the best pair never does, so each round gets on.
    Without ``rounds`` it goes on until no pair has ``least`` places that don't overlap.

    A round only reads the places where a pair can be frequent: those that were in the last round, and those beside its
    new symbols.  A pair of older symbols never gains a place.
    """
    sequence = ids.astype(np.uint32)
    rules, expansions, n_rules = [], [], 0
    size_of = np.ones(FIRST_RULE, dtype=np.uint32)
    hot = np.arange(max(len(sequence) - 1, 0))
    # The place before the first one and the one behind the last one have the worst rank, like all that have none.
    rank = np.full(len(sequence) + 1, _WORST, dtype=np.int32)
    for _ in itertools.count() if rounds is None else range(rounds):
        if not len(hot):
            break
        if rules:
            pairs = (sequence[hot].astype(np.uint64) << np.uint64(32)) | sequence[hot + 1]
        else:
            pairs = (sequence[:-1].astype(np.uint64) << np.uint64(32)) | sequence[1:]
        # In a run of one symbol every other place counts, from its first one on.
        again = np.flatnonzero((pairs[1:] == pairs[:-1]) & (hot[1:] - hot[:-1] == 1)) + 1
        if len(again):
            first_of_run = again[np.concatenate([[True], np.diff(again) > 1])]
            odd = again[(again - first_of_run[np.searchsorted(first_of_run, again, side="right") - 1]) % 2 == 0]
            apart = np.ones(len(pairs), dtype=bool)
            apart[odd] = False
            hot_apart, pairs_apart = hot[apart], pairs[apart]
        else:
            hot_apart, pairs_apart = hot, pairs
        if rules:
            ordered = np.sort(pairs_apart)
        else:  # two ids of the vocabulary fit in 32 bits, which sort in half the time
            packed = np.sort((pairs_apart >> np.uint64(16)).astype(np.uint32) | pairs_apart.astype(np.uint32)).astype(np.uint64)
            ordered = (packed >> np.uint64(16) << np.uint64(32)) | (packed & np.uint64(0xFFFF))
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        often = np.diff(edges)
        frequent = np.flatnonzero(often >= least)
        if not len(frequent):
            break
        # Best first: by count up to a factor of two, and mixed among those, so that neighbours rarely block each other
        # in a row.
        keys = ordered[edges[frequent]]
        mixed = keys * np.uint64(0xD6E8FEB86659FD93)
        best = np.lexsort((mixed, -np.log2(often[frequent]).astype(np.int64)))
        keys = keys[best]
        # A table without chains: of the pairs that share a slot the most frequent stays, the others wait.
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64)
        rank_at = np.full(_SLOTS, -1, dtype=np.int32)
        rank_at[slot[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)
        # Places whose slot is taken: all those of frequent pairs, and few others.
        at_slot = rank_at[((pairs_apart * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64)]
        known = np.flatnonzero(at_slot >= 0)
        hot_apart, pairs_apart, at_slot = hot_apart[known], pairs_apart[known], at_slot[known]
        met = np.flatnonzero(keys[at_slot] == pairs_apart)
        ranked, own = hot_apart[met], at_slot[met]
        rank[ranked + 1] = own
        better = np.flatnonzero((own < rank[ranked]) & (own <= rank[ranked + 2]))
        rank[ranked + 1] = _WORST
        places, taken = ranked[better], own[better]
        used = np.flatnonzero(np.bincount(taken, minlength=len(keys)) >= least)
        number_of = np.full(len(keys), -1, dtype=np.int64)
        number_of[used] = np.arange(len(used))
        number = number_of[taken]
        places, number = places[number >= 0], number[number >= 0]
        if not len(used):
            break
        left, right = (keys[used] >> np.uint64(32)).astype(np.uint32), keys[used].astype(np.uint32)
        first = FIRST_RULE + n_rules
        rules.append(np.stack([left, right], axis=1))
        expansions.append(size_of[left] + size_of[right])
        size_of = np.concatenate([size_of, expansions[-1]])
        n_rules += len(used)
        sequence[places] = first + number.astype(np.uint32)
        keep = np.ones(len(sequence), dtype=bool)
        keep[places + 1] = False
        stays = np.zeros(len(sequence), dtype=bool)
        # In a run of a frequent pair the places between count next time.
        stays[hot_apart] = stays[places] = stays[places[places > 0] - 1] = True
        if len(again):
            stays[hot[again]] = True
        sequence, hot = sequence[keep], np.flatnonzero(stays[keep])
        if len(hot) and hot[-1] == len(sequence) - 1:
            hot = hot[:-1]
    if not rules:
        return np.empty((0, 2), np.uint32), np.empty(0, np.uint32), sequence
    return np.concatenate(rules), np.concatenate(expansions), sequence


class Grammar:
    """Expands symbols of one shard.  All rules' expansions lie in one array, written rule by rule."""

    def __init__(self, rules: np.ndarray, expansions: np.ndarray):
        self.size = expansions.astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1] if len(self.size) else self.size
        self.flat = np.zeros(int(self.size.sum()), dtype=np.uint32)
        done = 0
        while done < len(rules):
            # Rules whose two members are terminals or rules before ``done`` are expanded together.
            ready = (rules[done:] < FIRST_RULE + done).all(axis=1)
            stop = done + (int(np.argmin(ready)) if not ready.all() else len(ready))
            own = rules[done:stop].reshape(-1)
            begin = int(self.at[done])
            self.flat[begin : begin + int(self.size[done:stop].sum())] = self.expand(own)
            done = stop

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of the symbols."""
        rule = symbols >= FIRST_RULE
        if not rule.any():
            return symbols.astype(np.uint32)
        number = np.where(rule, symbols.astype(np.int64) - FIRST_RULE, 0)
        # Terminals are looked up behind the expansions.
        flat = np.concatenate([self.flat, symbols[~rule].astype(np.uint32)])
        at = np.where(rule, self.at[number], len(self.flat) + np.cumsum(~rule) - 1)
        return gather(flat, at, np.where(rule, self.size[number], 1))

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= FIRST_RULE
        out = np.ones(len(symbols), dtype=np.int64)
        out[rule] = self.size[symbols[rule].astype(np.int64) - FIRST_RULE]
        return out


def decode_range(shard: dict, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop of one shard, expanding only the symbols that cover them."""
    read = lambda name: np.frombuffer(shard[name], "<u4")
    grammar = Grammar(read("rules").reshape(-1, 2), read("expansions"))
    sequence = read("sequence")
    ends = np.cumsum(grammar.sizes(sequence))
    first = int(np.searchsorted(ends, start, side="right"))
    last = int(np.searchsorted(ends, stop, side="left")) + 1
    skipped = int(ends[first - 1]) if first else 0
    return grammar.expand(sequence[first:last])[start - skipped : stop - skipped]


_STORE = "part int, shard int, doc_ids array<{kind}>, lengths binary, rules binary, expansions binary, sequence binary, n_ids long"


def _shards(path: str, kind: pa.DataType, shard_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def row(part: int, shard: int, docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        rules, expansions, sequence = compress(np.concatenate(ids))
        binary = lambda x: pa.array([np.ascontiguousarray(x, dtype="<u4").tobytes()], pa.binary())
        lengths = [len(x) for x in ids]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([docs], pa.list_(kind)), binary(lengths),
             binary(rules), binary(expansions), binary(sequence), pa.array([sum(lengths)], pa.int64())],
            ["part", "shard", "doc_ids", "lengths", "rules", "expansions", "sequence", "n_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _library(path)
        docs, ids, held, shard, part = [], [], 0, 0, 0
        for batch in batches:
            for texts in ta.slices(batch.column(2), SLICE_BYTES):
                part = batch.column(0)[0].as_py()
                found, cuts = table.texts(texts)
                # The end id goes behind each text's ids.
                found = np.insert(found, cuts[1:], END_ID)
                cuts = (cuts + np.arange(texts.n + 1)).tolist()
                names = batch.column(1).slice(texts.first, texts.n).to_pylist()
                for name, a, b in zip(names, cuts, cuts[1:], strict=False):
                    docs.append(name)
                    ids.append(found[a:b])
                    held += b - a
                    if held >= shard_ids:
                        yield row(part, shard, docs, ids)
                        docs, ids, held, shard = [], [], 0, shard + 1
        if docs:
            yield row(part, shard, docs, ids)

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode and write all documents in ascending order of doc_id."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = rows.schema["doc_id"].dataType
    ordered = rows.repartitionByRange(max(1, -(-size // PART_BYTES)), "doc_id").sortWithinPartitions("doc_id")
    arrow_kind = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(
        _shards(tokenizer, arrow_kind, shard_ids), _STORE.format(kind=kind.simpleString())
    ).write.parquet(path)


def shard_starts(store: DataFrame) -> DataFrame:
    """part, shard and the number of ids before the shard; sums go by part first, so no task sees all shards."""
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return store.select("part", "shard", inside.alias("inside")).join(before, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("start"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            read = lambda name, b=batch, i=i: np.frombuffer(b.column(name)[i].as_buffer(), "<u4")
            ids = Grammar(read("rules").reshape(-1, 2), read("expansions")).expand(read("sequence"))
            lengths = read("lengths").astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            raw, at = ids.astype("<u4").tobytes(), (cuts * 4).tolist()
            start = batch.column("start")[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_ids")[i].values, pa.array(start + cuts[:-1]), pa.array(lengths),
                 pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"])


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _documents(batches):
        sums = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column(3)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], sums], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _with_starts(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    store = ship(spark).read.parquet(path)
    kind = store.schema["doc_ids"].dataType.elementType.simpleString()
    columns = ["start", "doc_ids", "lengths", "rules", "expansions", "sequence"]
    return store.join(shard_starts(store), ["part", "shard"]).select(*columns), kind


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) of every document."""
    rows, kind = _with_starts(spark, path)
    return rows.mapInArrow(_documents, f"doc_id {kind}, start long, n_tokens long, ids binary")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_path())
    rows, kind = _with_starts(spark, path)
    return rows.mapInArrow(_checksums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
