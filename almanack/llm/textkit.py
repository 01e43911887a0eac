"""Vectorised text primitives over Arrow batches: word bounds, rolling hashes, bounded slices.

Every function works on whole texts. A slice holds at least one text, so a text longer than
the slice limit is processed alone and in full.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a single longer text still goes in whole.
SLICE_BYTES = 1 << 20
#: Odd multipliers of the rolling hashes.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker; only for caches that may be lost."""
    return sys.__dict__.setdefault("_almanack_state", {})


def release() -> None:
    """Give freed memory back to the system; Python workers are used again for other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, keep: tuple | None = None):
    """Yield (batch slice, bytes as uint8, offsets from 0) of at most `limit` bytes or one row. Null: empty.

    keep: the key of worker_state that this work uses; caches of other work go, as workers serve many stages.
    """
    for key in worker_state().keys() - {keep}:
        del worker_state()[key]
    for batch in batches:
        text = batch.column(column)
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        if text.null_count:
            text = text.fill_null("" if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else b"")
        wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
        n = len(text)
        if not n:
            continue
        _, offsets, data = text.buffers()
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and off[-1] else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
            yield batch.slice(lo, hi - lo), raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi
    release()


def byte_set(expr) -> np.ndarray:
    """Boolean table over the 256 bytes."""
    table = np.zeros(256, bool)
    table[list(expr)] = True
    return table


#: Bytes of [\x20\x09-\x0D]; words are the runs between them.
SPACES = byte_set([0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
NOT_ITEM_WORD = byte_set([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def word_bounds(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every maximal run of non-separator bytes; runs end with their row."""
    inside = ~separators[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    before[:-1], before[-1] = inside[1:], False
    before[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~before) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Rolling:
    """Polynomial hashes modulo 2^64 of any range of a sequence, by prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0
        self._grow(1)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                powers = np.full(self.size + 1, b, U64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values))
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return sums

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(U64))


#: 256 pseudo-random 64-bit values, from a rule.
BYTE_VALUES = mix(mix(np.arange(1, 257, dtype=U64) * U64(BYTE_BASE)))
LOWER_VALUES = BYTE_VALUES[LOWER]


class WordHasher:
    """Hashes of words and of runs of words."""

    def __init__(self, lower: bool = False):
        self.bytes, self.words = Rolling(BYTE_BASE), Rolling(WORD_BASE)
        self.values = LOWER_VALUES if lower else BYTE_VALUES

    def word_hashes(self, data, starts, ends) -> np.ndarray:
        return self.bytes.ranges(self.bytes.prefix(self.values[data]), starts, ends)

    def gram_hashes(self, words: np.ndarray, k: int) -> np.ndarray:
        """Of the k words from each position that has k words after it, row bounds not regarded."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        at = np.arange(n)
        return self.words.ranges(self.words.prefix(words), at, at + k)


def row_starts(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Index of the first word of each row, and the end: n_rows + 1 values."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Boolean mask of n places covered by [s, s + length) for any s."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + length, n), -1)
    return np.cumsum(delta[:-1]) > 0
