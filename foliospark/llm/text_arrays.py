"""Texts of an Arrow column as flat arrays: words, hashes of words and of runs of words.

Python here touches no single word: a block of texts is one byte array, words are found by
comparisons on it, and the hash of any byte range is a difference of prefix sums modulo 2**64.
Blocks hold about BLOCK bytes whatever a text's length, so memory stays bounded.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once. A longer text is cut after white space.
BLOCK = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection whose bits all depend on all bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def numbers(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same everywhere."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1_000_003)) * _BASE)


_BYTES = numbers(7, 256) | _U(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
#: For hashes that ignore ASCII punctuation.
_LETTERS = _LOWER.copy()
_PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_LETTERS[_PUNCTUATION] = _U(0)

_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


class Ranges:
    """Hashes of ranges of one array, by prefix sums."""

    def __init__(self, values: np.ndarray, exponents: np.ndarray | None = None):
        n = len(values)
        up, _ = _power(n + 1)
        self.exponents = exponents
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values * (up[:n] if exponents is None else up[exponents[:n]]), out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = _power(len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * down[starts if self.exponents is None else self.exponents[starts]])


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, null) of a string or binary array; a null text has no bytes."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks() if values.num_chunks != 1 else values.chunk(0)
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    n = len(values)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    null = np.asarray(values.is_null(), bool) if n else np.zeros(0, bool)
    return buf, at - at[0], null


def row_slices(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


class Words:
    """The words of a block of texts.

    starts, ends: byte positions; bounds: words of row i are bounds[i]:bounds[i + 1];
    hashes: of each word, with A-Z as a-z (``fold``), without punctuation (``bare``) or of the plain bytes.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, fold: bool = True, bare: bool = False):
        table = _LETTERS if bare else _LOWER if fold else _BYTES
        starts, ends, hashes = [], [], []
        for a, b in self._blocks(buf, offsets):
            s, e = self._find(buf[a:b], offsets, a, b)
            part = buf[a:b]
            if bare:
                kept = np.zeros(len(part) + 1, np.int64)
                np.cumsum(table[part] != 0, out=kept[1:])
                hashes.append(Ranges(table[part], kept).hash(s, e))
            else:
                hashes.append(Ranges(table[part]).hash(s, e))
            starts.append(s + a)
            ends.append(e + a)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    @staticmethod
    def _blocks(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        a, n = 0, len(buf)
        while a < n:
            b = min(n, a + BLOCK)
            if b < n:
                at = offsets[np.searchsorted(offsets, b, "right") - 1]
                if at > a:
                    b = int(at)
                else:
                    blank = np.flatnonzero(SPACE[buf[a:b]])
                    if len(blank):
                        b = a + int(blank[-1]) + 1
                    else:
                        stop = int(offsets[np.searchsorted(offsets, b, "left")])
                        blank = np.flatnonzero(SPACE[buf[b:stop]])
                        b = b + int(blank[0]) if len(blank) else stop
            yield a, b
            a = b

    @staticmethod
    def _find(part: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        blank = SPACE[part]
        edge = offsets[(offsets > a) & (offsets < b)] - a
        before, after = np.empty(len(part), bool), np.empty(len(part), bool)
        before[0], before[1:] = True, blank[:-1]
        after[-1], after[:-1] = True, blank[1:]
        before[edge] = True
        after[edge - 1] = True
        return np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of n words; a row with fewer words gives its whole sequence as one."""
    h, rows = words.hashes, words.rows()
    if len(h) >= n:
        whole = Ranges(h)
        at = np.arange(len(h) - n + 1)
        same = rows[: len(rows) - n + 1] == rows[n - 1 :]
        at = at[same]
        long_hash, long_row = whole.hash(at, at + n), rows[at]
    else:
        long_hash, long_row = np.zeros(0, _U), np.zeros(0, np.int64)
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if not len(few):
        return long_hash, long_row
    short = Ranges(h).hash(words.bounds[few], words.bounds[few + 1]) if len(h) else np.zeros(0, _U)
    short = mix(short ^ numbers(11, n)[words.counts[few]])
    both, row = np.concatenate([long_hash, short]), np.concatenate([long_row, few])
    order = np.argsort(row, kind="stable")
    return both[order], row[order]


def distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each row's distinct hashes in ascending order; rows must be ascending."""
    bounds = np.searchsorted(rows, np.arange(n + 1))
    out = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    if len(out):
        keep[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out[keep], kept[bounds]


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values).cast(kind) if not pa.types.is_int64(kind) else pa.array(values.view(np.int64) if values.dtype == _U else values.astype(np.int64)))


def release() -> None:
    """Gives memory that is free in this process back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for a task that leaves no free memory held: its worker lives on beside its executor and other tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
