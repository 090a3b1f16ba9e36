"""Words and word windows of whole Arrow text columns as numpy arrays.

A batch is read straight from its UTF-8 buffer: word bounds come from a byte table, word
fingerprints from prefix sums of a polynomial over the bytes (one 64-bit value per word,
equal for equal words), and window fingerprints from the same sums over the words. No Python
string is made per word. Bytes of 0x80 and above are always word bytes, so a byte table
expresses both word rules used here exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5           # odd: invertible modulo 2**64
_WORD_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _fold_case(values: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[65:91] = values[97:123]
    return out


_VALUES = _byte_values(20240229)
_FOLDED = _fold_case(_VALUES)

SPACED = np.ones(256, bool)               # words [^\x20\x09-\x0D]+
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)               # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
LETTERS = ALNUM.copy()                    # ASCII letters and everything beyond ASCII
LETTERS[0x30:0x3A] = False


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _WORDS2 = Powers(_BASE), Powers(_WORD_BASE), Powers(0xC2B2AE3D27D4EB4F | 5)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    lo, hi = int(offs[0]), int(offs[-1])
    if data is None or hi == lo:
        return np.zeros(0, np.uint8), offs - lo
    return np.frombuffer(data, np.uint8)[lo:hi], offs - lo


class Words:
    """Word bounds (byte offsets), per-document word offsets and word fingerprints of a batch."""

    def __init__(self, column: pa.Array, table: np.ndarray, lower: bool, fingerprints: bool = True):
        self.data, self.offsets = text_buffer(column)
        n, data, offs = len(self.data), self.data, self.offsets
        inside = table[data]
        starts, ends = inside.copy(), np.zeros(n + 1, bool)
        starts[1:] &= ~inside[:-1]
        ends[1:] = inside
        ends[1:n] &= ~inside[1:]
        edge = offs[(offs > 0) & (offs < n)]
        starts[edge] = inside[edge]
        ends[edge] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offs)     # word range of document d: first[d]:first[d + 1]
        if fingerprints:
            self.hash = _fingerprints(data, self.start, self.end, _FOLDED if lower else _VALUES)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, fingerprint) of every run of ``length`` words within one document."""
        n = len(self.hash)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - length + 1)
        left = np.repeat(self.first[1:], self.counts)[:n - length + 1]
        at = at[at + length <= left]
        return at, self.window_hash(length)[at]

    def window_hash(self, length: int, second: bool = False) -> np.ndarray:
        """Fingerprint of ``length`` consecutive words from each word on, documents ignored; ``second``: another one."""
        up, down = (_WORDS2 if second else _WORDS).upto(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], out=sums[1:])
        k = len(self.hash) - length + 1
        return mix((sums[length:] - sums[:k]) * down[:k])


def _fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):                  # segments of about SLICE_BYTES that end between words
        j = max(i + 1, int(np.searchsorted(start, start[i] + SLICE_BYTES)))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _BYTES.upto(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * up[:-1], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        i = j
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` text bytes, one document at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i, done = 0, 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(i, j - i)
            i, done = j, int(ends[j - 1])


def long_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """array<long> column from flat 64-bit values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64)))


def int_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))
