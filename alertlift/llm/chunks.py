"""Cutting texts where byte-level BPE cannot merge, so that distinct pieces are encoded once.

The pre-tokenizer's pattern never joins a character that is not white space with a following single blank or line
feed, and takes such a blank together with what follows it.  A text whose white space is single blanks and line feeds
between other characters can therefore be cut before each of them, and each chunk encoded by itself.  Any other text
is one chunk.  Chunks of plain characters, without apostrophes, are cut further into the pattern's words: runs of
letters, of digits or of others, the first with its blank.

Pieces are found and told apart as arrays: a 64-bit hash finds a piece in the table, a second one confirms it.
"""

from __future__ import annotations

import gc
import itertools
from collections.abc import Callable

import numpy as np
import regex

from alertlift.llm import textarrays as ta

#: Chunks and ids that a task keeps; beyond either, the table starts anew.
HELD, HELD_IDS = 350_000, 4_000_000

_CUT = np.zeros(256, dtype=bool)
_CUT[[0x20, 0x0A]] = True
#: ASCII white space of either pattern engine, without blank and line feed.
_OTHER_SPACE = np.zeros(256, dtype=bool)
_OTHER_SPACE[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII, by its UTF-8 bytes."""
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if not len(lead):
        return lead
    padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
    a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
    general = (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    latin = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    other = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return lead[general | latin | other]


#: Below this character the pattern's classes are the same in all versions of Unicode in use.
SETTLED = 0x530
_LETTER, _NUMBER, _OTHER, _UNSETTLED = 1, 2, 3, 4


def _classes() -> np.ndarray:
    out = np.full(0x800, _UNSETTLED, dtype=np.uint8)
    for i in range(SETTLED):
        c = chr(i)
        out[i] = _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else 0 if regex.match(r"\s", c) else _OTHER
    return out


_CLASSES = _classes()
_BYTE_CLASSES = np.where(np.arange(256) < 0x80, _CLASSES[:256], _UNSETTLED).astype(np.uint8)


def character_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character; longer than two bytes is unsettled."""
    out = _BYTE_CLASSES[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xDF))
    if len(lead):
        own = _CLASSES[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
        out[lead] = out[lead + 1] = own
    return out


def cut(texts: ta.Texts, added: list[bytes]) -> tuple[ta.Spans, np.ndarray]:
    """Pieces of each text, together all its bytes, and which of them are words of the pattern."""
    data, offsets = texts.data, texts.offsets
    lengths = texts.lengths()
    full = lengths > 0
    at = _CUT[data]
    next_to = np.flatnonzero(at[1:] & at[:-1])
    edges = np.concatenate([offsets[:-1][full], offsets[1:][full] - 1])
    odd = np.concatenate([np.flatnonzero(_OTHER_SPACE[data]), next_to, _wide_space(data), edges[at[edges]]])
    whole = np.zeros(texts.n, dtype=bool)
    whole[np.searchsorted(offsets, odd, side="right") - 1] = True
    in_whole = np.repeat(whole, lengths)
    begin = at & ~in_whole
    begin[offsets[:-1][full]] = True
    # Within plain chunks a word begins where the class changes, but for the character behind the chunk's blank.
    classes = character_classes(data)
    hard = in_whole | (classes == _UNSETTLED) | (data == 0x27)
    if added:
        raw = data.tobytes()
        for token in added:
            place = raw.find(token)
            while place >= 0:
                hard[place] = True
                place = raw.find(token, place + 1)
    chunk = np.flatnonzero(begin)
    if not len(chunk):
        none = np.empty(0, dtype=np.int64)
        return ta.Spans(none, none, none, np.zeros(texts.n + 1, dtype=np.int64)), none.astype(bool)
    plain = ~np.logical_or.reduceat(hard, chunk)
    plain_byte = np.repeat(plain, np.diff(np.append(chunk, len(data))))
    begin[1:] |= plain_byte[1:] & (classes[1:] != classes[:-1]) & (data[:-1] != 0x20)
    start = np.flatnonzero(begin)
    before = np.searchsorted(start, offsets, side="left")
    return ta.Spans(start, np.append(start[1:], len(data)), np.repeat(np.arange(texts.n), np.diff(before)), before), plain_byte[start]


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[at[0]:at[0]+size[0]], flat[at[1]:...], ... one after the other; no size is 0."""
    total = np.cumsum(size)
    index = np.ones(int(total[-1]) if len(total) else 0, dtype=np.int64)
    if len(index):
        index[0] = at[0]
        index[total[:-1]] = at[1:] - (at[:-1] + size[:-1] - 1)
        np.cumsum(index, out=index)
    return flat[index]


class ChunkTable:
    """Encoded pieces, and the encoding of texts by them.

    ``encode_words`` encodes words of the pattern (UTF-8, sorted), ``encode_all`` any texts, each to the bytes of
    its little-endian unsigned 32-bit ids.  ``added``: tokens that are cut out before the pattern applies.
    ``ordered`` False: ``encode_words`` takes words in any order.
    """

    def __init__(
        self,
        encode_words: Callable[[list[bytes]], list[bytes]],
        encode_all: Callable[[list[str]], list[bytes]],
        added: list[str],
        held: int = HELD,
        held_ids: int = HELD_IDS,
        ordered: bool = True,
    ):
        self.ordered = ordered
        self.encode_words, self.encode_all, self.held, self.held_ids = encode_words, encode_all, held, held_ids
        self.added = [x.encode("utf-8") for x in added]
        self._clear()

    def _clear(self) -> None:
        self.number: dict[int, int] = {}
        self.check = np.empty(0, dtype=np.uint64)
        self.at, self.size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.uint32)

    def _add(self, keys: list[int], check: np.ndarray, pieces: list[bytes], words: list[bool]) -> None:
        ids: list[bytes] = [b""] * len(pieces)
        order = [i for i, w in enumerate(words) if w]
        if self.ordered:
            order.sort(key=pieces.__getitem__)
        for i, found in zip(order, self.encode_words([pieces[i] for i in order]), strict=True):
            ids[i] = found
        others = [i for i, w in enumerate(words) if not w]
        for i, found in zip(others, self.encode_all([pieces[i].decode("utf-8") for i in others]), strict=True):
            ids[i] = found
        size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        self.number.update(zip(keys, range(len(self.check), len(self.check) + len(keys)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.check = np.concatenate([self.check, check])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])

    def texts(self, texts: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 places where texts begin and end in them."""
        gc.disable()  # many short objects and no cycles: looking for cycles takes a fifth of the time
        try:
            return self._texts(texts)
        finally:
            gc.enable()

    def _texts(self, texts: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
        pieces, is_word = cut(texts, self.added)
        if not len(pieces.start):
            return np.empty(0, dtype=np.uint32), np.zeros(texts.n + 1, dtype=np.int64)
        keys = ta.span_hashes(texts.data, pieces.start, pieces.end)
        check = ta.span_hashes(texts.data, pieces.start, pieces.end, variant=1)
        # A piece may be a word in one place and hard in another only if its bytes differ.
        order = np.argsort(keys)
        ordered = keys[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        first, back = order[fresh], np.empty(len(order), dtype=np.int64)
        back[order] = np.cumsum(fresh) - 1
        names = ordered[fresh].tolist()
        number = np.fromiter(map(self.number.get, names, itertools.repeat(-1)), dtype=np.int64, count=len(names))
        missing = np.flatnonzero(number < 0)
        if len(self.check) + len(missing) > self.held or len(self.flat) > self.held_ids:
            self._clear()
            missing = np.arange(len(names))
        if len(missing):
            raw, where = texts.data.tobytes(), first[missing]
            spans = zip(pieces.start[where].tolist(), pieces.end[where].tolist(), strict=True)
            number[missing] = len(self.check) + np.arange(len(missing))
            self._add([names[i] for i in missing.tolist()], check[where], [raw[a:b] for a, b in spans], is_word[where].tolist())
        number = number[back]
        if (self.check[number] != check).any():
            raise ValueError("two different pieces have one hash")
        size = self.size[number]
        ids = gather(self.flat, self.at[number], size)
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[pieces.before]


class Kept:
    """A bounded table of words: when ``new`` is full it becomes ``old``, and what is asked for again moves back."""

    def __init__(self, held: int = 50_000):
        self.held, self.new, self.old = held, {}, {}

    def lacking(self, keys: set) -> list:
        """Keys that neither generation has, after moving those of the old one; all of ``keys`` stay until the next call."""
        missing = {k for k in keys if k not in self.new}
        if len(self.new) + len(missing) > self.held:
            self.old, self.new, missing = self.new, {}, keys
        moved = {k: self.old[k] for k in missing if k in self.old}
        self.new.update(moved)
        return sorted(missing - moved.keys())
