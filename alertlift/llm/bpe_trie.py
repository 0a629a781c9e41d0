"""Byte-level BPE by a prefix-sharing trie of distinct words, and its decoding (operator 7).

The BPE encoding of a prefix ends in exactly one token t such that t is a suffix of the prefix and BPE would not merge
across the border between t and the last token of what is left.  So a trie node needs one state, its prefix's last
token, found from the states above it; an encoding is read by jumping back token by token.  The distinct words are
laid out in depth-first order of their trie (sorted, each sharing the path of its common prefix with the word before),
and a shared prefix is worked out once.

Whether BPE merges across the border of two tokens follows from the merge tree: along the right edge of the left token
and the left edge of the right one, a pair merges if its rank comes before both of its members are used up.

Added tokens are cut out first.  Words come from the tokenizer's own pattern; chunks with characters on which
Unicode versions may differ are cut by the tokenizers library.

Defined results: a null text counts as empty and has no tokens; texts count whole; repeated rows get equal results;
an empty table gives no rows.  Only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.llm import textarrays as ta
from alertlift.llm.chunks import SETTLED, ChunkTable, Kept
from alertlift.llm.shipping import ship

VOCABULARY = "byte_bpe_50k.json"

#: Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHIFT = 20
#: Pairs of tokens that a task remembers; beyond, it starts anew.
PAIRS_HELD = 300_000


def public_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself where printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Trie:
    """Encodes words; built from a tokenizer's vocabulary and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_characters()
        raw = lambda token: bytes(letters[c] for c in token)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        vocabulary = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.added}
        self.ids = {raw(k): v for k, v in vocabulary.items()}
        self.bytes_of: list[bytes] = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in added.items():
            self.bytes_of[i] = token.encode("utf-8")
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.rank[a << _SHIFT | b] = rank
            self.parts.setdefault(c, (a, b, rank))
        self.longest = max(map(len, self.ids))
        self._edges: tuple[dict, dict] = ({}, {})
        self._apart: dict[int, bool] = {}
        self.words = Kept()
        self._pattern = regex.compile(PATTERN)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._library = None
        self.path = path

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens on the left (0) or right (1) edge of a token's merge tree, and the rank at which each is used up."""
        known = self._edges[side].get(token)
        if known is None:
            known, used, at = [(token, float("inf"))], self.parts.get(token), token
            while used is not None:
                at = used[side]
                known.append((at, used[2]))
                used = self.parts.get(at)
            self._edges[side][token] = known
        return known

    def apart(self, a: int, b: int) -> bool:
        """BPE keeps tokens a and b, side by side, as they are.  A pair of equal rank goes to the left one first."""
        key = a << _SHIFT | b
        known = self._apart.get(key)
        if known is None:
            known = True
            for x, x_used in self._edge(a, 1):
                for y, y_used in self._edge(b, 0):
                    rank = self.rank.get(x << _SHIFT | y)
                    if rank is not None and rank < x_used and rank <= y_used:
                        known = False
            if len(self._apart) > PAIRS_HELD:
                self._apart.clear()
            self._apart[key] = known
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of sorted distinct words: one walk over their trie in depth-first order."""
        ids, apart, longest, bytes_of = self.ids, self.apart, self.longest, self.bytes_of
        path: list[int] = []  # the last token of every prefix of the word at hand
        before = b""
        out = []
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared:]
            for end in range(shared + 1, len(word) + 1):
                # Mostly the token before grows or gives way to a shorter one; only one start fits, in any order.
                grown = end - 1 - len(bytes_of[path[-1]]) if path else 0
                for start in (*range(grown, end), *range(grown - 1, max(0, end - longest) - 1, -1)):
                    token = ids.get(word[start:end])
                    if token is not None and (start == 0 or apart(path[start - 1], token)):
                        path.append(token)
                        break
            at, found = len(word), []
            while at:
                token = path[at - 1]
                found.append(token)
                at -= len(bytes_of[token])
            out.append(found[::-1])
            before = word
        return out

    def words_to_bytes(self, words: list[bytes]) -> list[bytes]:
        return [struct.pack(f"<{len(x)}I", *x) for x in self.encode_words(words)]

    def split(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        if text.isascii() or ord(max(text)) < SETTLED:
            return self._pattern.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = []
        for text in texts:
            pieces = self._cut.split(text) if self._cut and self._cut.search(text) else [text]
            split.append([w for p in pieces for w in ([p] if p in self.added else self.split(p))])
        new = self.words.lacking({w for s in split for w in s if w not in self.added})
        in_order = sorted(w.encode("utf-8") for w in new)
        self.words.new.update((w.decode("utf-8"), x) for w, x in zip(in_order, self.words_to_bytes(in_order), strict=True))
        known = self.words.new.__getitem__ if not self.added else lambda w, of=self.words.new: of.get(w) or self.added[w]
        return [b"".join(map(known, s)) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, added tokens as they are written; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


_tries: dict[str, tuple[Trie, ChunkTable]] = {}


def trie_of(path: str) -> tuple[Trie, ChunkTable]:
    """The trie of a vocabulary file and its chunks, kept by the worker process."""
    if path not in _tries:
        trie = Trie(path)
        _tries[path] = trie, ChunkTable(trie.words_to_bytes, trie.encode_all, list(trie.added))
    return _tries[path]


def _encode(path: str, carried: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = trie_of(path)
        for batch in batches:
            for texts in ta.slices(batch.column(0)):
                ids, cuts = table.texts(texts)
                raw, at = ids.astype("<u4").tobytes(), (cuts * 4).tolist()
                own = [c.slice(texts.first, texts.n) for c in batch.columns[1:]]
                values = pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*own, values, pa.array(np.diff(cuts))], [*carried, "ids", "n_tokens"])

    return run


def encode(docs: DataFrame, path: str, *carried: str) -> DataFrame:
    """The carried columns with ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` of the whole text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string"), *carried)
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carried)
    return rows.mapInArrow(_encode(path, list(carried)), f"{schema}ids binary, n_tokens long")


def _decode(path: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, _ = trie_of(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [trie.decode(np.frombuffer(x.as_buffer(), "<u4")) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names)

    return run


def decode(encoded: DataFrame, path: str, *carried: str) -> DataFrame:
    """The carried columns with ``text`` decoded from ``ids``."""
    ship(encoded.sparkSession)
    rows = encoded.select("ids", *carried)
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carried)
    return rows.mapInArrow(_decode(path, [*carried, "text"]), f"{schema}text string")


def _digests(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encodes, decodes what it encoded, and digests both, so that neither ids nor text leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in _encode(path, ["doc_id"])(batches):
            trie, _ = trie_of(path)
            ids = [x.as_buffer() for x in batch.column(1)]
            of = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(trie.decode(np.frombuffer(x, "<u4")).encode("utf-8")).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(of), pa.array(back)], names)

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string"), "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_digests(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path())
