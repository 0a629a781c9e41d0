"""Whole texts as byte arrays: words, lines and hashes without a Python loop per word.

Used inside ``mapInArrow`` tasks.  A batch of texts is one UTF-8 byte array with offsets; it is worked on in
slices of a few megabytes, so memory follows the slice (or the longest single text), not the batch.

A word is ``[^\\x20\\x09-\\x0D]+``.  Its separators are ASCII, so words can be found in the bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
SLICE_ROWS = 2048

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix_int(x: int) -> int:
    """The finaliser of SplitMix64 on one number."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


#: One random-looking 64-bit value for each byte, and odd factors for positions in a window.
BYTE_VALUES = np.array([_mix_int(_GOLDEN * (i + 1) & _MASK) for i in range(256)], dtype=np.uint64)
FACTORS = np.array([_mix_int(_GOLDEN * (i + 1001) & _MASK) | 1 for i in range(64)], dtype=np.uint64)
_VARIANT_VALUES = [BYTE_VALUES, np.array([_mix_int(_GOLDEN * (i + 5001) & _MASK) for i in range(256)], dtype=np.uint64)]
_BASES = [(b, pow(b, -1, 1 << 64)) for b in (_mix_int(77) | 5, _mix_int(78) | 5)]
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Rows ``first`` .. ``first + n`` of a batch: UTF-8 bytes, n + 1 offsets, and which texts are not null."""

    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray
    first: int

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def lowered(self) -> Texts:
        """A-Z in lower case; all other characters stay."""
        return Texts(_LOWER[self.data], self.offsets, self.valid, self.first)

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8")


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[Texts]:
    """The texts of an Arrow column in slices of about ``max_bytes``; nulls count as empty texts."""
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
    binary = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(binary):
        return
    buffers = binary.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    start = 0
    while start < len(binary):
        stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), start + max_rows, len(binary))
        low, high = offsets[start], offsets[stop]
        yield Texts(data[low:high], offsets[start : stop + 1] - low, valid[start:stop], start)
        start = stop


@dataclass
class Spans:
    """Runs of bytes: start, end, the row they are in, and the number of runs before each row (n + 1 values)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    before: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.before)


def runs(member: np.ndarray, offsets: np.ndarray) -> Spans:
    """Maximal runs of True bytes within each row."""
    n = len(member)
    after = np.zeros(n + 1, dtype=bool)
    after[1:] = member
    full = offsets[:-1][np.diff(offsets) > 0]
    after[full] = False
    start = np.flatnonzero(member & ~after[:-1])
    ahead = np.zeros(n + 1, dtype=bool)
    ahead[:-1] = member
    ahead[full] = False
    end = np.flatnonzero(member & ~ahead[1:]) + 1
    before = np.searchsorted(start, offsets, side="left")
    return Spans(start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(before)), before)


def words(texts: Texts) -> Spans:
    return runs(_WORD[texts.data], texts.offsets)


def lines(texts: Texts) -> Spans:
    """The pieces between line feeds, empty ones too (a text has one more than it has line feeds)."""
    cuts = np.flatnonzero(texts.data == 0x0A)
    per_row = np.diff(np.searchsorted(cuts, texts.offsets, side="left"))
    start = np.sort(np.concatenate([texts.offsets[:-1], cuts + 1]), kind="stable")
    end = np.sort(np.concatenate([texts.offsets[1:], cuts]), kind="stable")
    before = np.concatenate([[0], np.cumsum(per_row + 1)])
    return Spans(start, end, np.repeat(np.arange(texts.n), per_row + 1), before)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, variant: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by differences of one running sum over the slice.

    Variants use other values for bytes and places; two of them together make a hash of 128 bits.
    """
    n = len(data)
    base, inverse = _BASES[variant]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VARIANT_VALUES[variant][data] * _power_table(base, n), out=total[1:])
    own = (total[end] - total[start]) * _power_table(inverse, n + 1)[start]
    return mix(own + (end - start).astype(np.uint64) * np.uint64(_GOLDEN))


def window_hashes(hashes: np.ndarray, spans: Spans, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window of ``width`` words that lies within one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(spans.row[:n] == spans.row[width - 1 :])
    total = np.full(len(first), width * _GOLDEN & _MASK, dtype=np.uint64)
    for j in range(width):
        total += hashes[first + j] * FACTORS[j]
    return mix(total), first


def row_sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, given the number of values before it."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[before[1:]] - total[before[:-1]]


def characters(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80
