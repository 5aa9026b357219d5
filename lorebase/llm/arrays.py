"""Whole batches of texts as numpy arrays of word hashes.

A word is a run of bytes that are not separators.  Its 64-bit hash is a
polynomial over random byte values, read off one prefix sum per slice of the
batch, so neither documents nor words are touched one by one.  Slices end at
separators and hold about ``SLICE`` bytes: a batch of any size, or a single text
of any length, needs the memory of one slice besides its words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 1 << 20)  # arrays of a megabyte or more go back to the system when they are freed
    pa.set_memory_pool(pa.system_memory_pool())  # and so do batches
except (OSError, AttributeError):  # another C library
    _LIBC = None

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: The six white-space bytes of ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: These and all other ASCII bytes that are neither letters nor digits.
NON_WORD = bytes(b for b in range(128) if not chr(b).isalnum())


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def tidy() -> None:
    """Give unused memory back: Spark's Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidied(f: Callable) -> Callable:
    """``f``, a function of a group or of two, with a tidy worker after each."""

    def kept(*tables: pa.Table) -> pa.Table:
        try:
            return f(*tables)
        finally:
            tidy()

    # Spark counts the parameters of what it is given
    return (lambda part: kept(part)) if f.__code__.co_argcount == 1 else (lambda part, other: kept(part, other))


@lru_cache(maxsize=8)
def _tables(lower: bool, separators: bytes, salt: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.random.default_rng(77 + salt).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    gaps = np.zeros(256, bool)
    gaps[list(separators)] = True
    values[gaps] = 0
    return values, gaps


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


@dataclass
class Words:
    """Words of ``n`` texts in order.  ``offsets[i]:offsets[i+1]`` are text i's."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    affixes: list[np.ndarray]

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes and n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = True, separators: bytes = SPACES, salt: int = 0, prefixes: tuple[int, ...] = (), suffixes: tuple[int, ...] = (), hashed: bool = True) -> Words:
    """Find and hash all words.  ``prefixes``/``suffixes``: also hash that many bytes of either end."""
    data, bounds = text_bytes(column)
    values, gaps = _tables(lower, separators, salt)
    hashes, starts, ends, affixes = [], [], [], [[] for _ in (*prefixes, *suffixes)]
    at = 0
    inner = bounds[1:-1]
    while at < len(data):
        stop = min(len(data), at + SLICE)
        while stop < len(data) and not gaps[data[stop - 1]]:
            # widen the slice to the next separator or text end
            more = np.flatnonzero(gaps[data[stop : stop + SLICE]])
            nxt = bounds[np.searchsorted(bounds, stop)]
            found = stop + int(more[0]) + 1 if len(more) else min(len(data), stop + SLICE)
            if nxt <= found:
                stop = int(nxt)
                break
            stop = found
        b = data[at:stop]
        gap = gaps[b]
        first = np.empty(len(b), bool)
        first[0] = True
        first[1:] = gap[:-1]
        last = np.empty(len(b), bool)
        last[-1] = True
        last[:-1] = gap[1:]
        cuts = inner[np.searchsorted(inner, at, "right") : np.searchsorted(inner, stop)] - at
        first[cuts] = True
        last[cuts - 1] = True
        first &= ~gap
        last &= ~gap
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if hashed and len(s):
            size = 1 << max(20, int(len(b)).bit_length())
            power, inverse = _powers(size)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(values[b] * power[: len(b)], out=sums[1:])
            undo = inverse[s]
            hashes.append(mix((sums[e] - sums[s]) * undo))
            for out, k in zip(affixes, prefixes, strict=False):
                out.append(mix((sums[np.minimum(s + k, e)] - sums[s]) * undo + np.uint64(k * 7919)))
            for out, k in zip(affixes[len(prefixes) :], suffixes, strict=True):
                t = np.maximum(s, e - k)
                out.append(mix((sums[e] - sums[t]) * inverse[t] + np.uint64(k * 104729)))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    s = join(starts, np.int64)
    return Words(join(hashes, np.uint64), np.searchsorted(s, bounds), s, join(ends, np.int64), data, [join(x, np.uint64) for x in affixes])


def runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs inside one text, and the word each starts at."""
    h = words.hashes
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(_BASE) + h[i : i + n]
    where = inside(words, k, n)
    return mix(total[where]), where


def inside(words: Words, k: int, n: int | None = None) -> np.ndarray:
    """Word positions from which k words follow in the same text."""
    n = len(words.hashes) - k + 1 if n is None else n
    if n <= 0:
        return np.zeros(0, np.int64)
    end = np.repeat(words.offsets[1:], words.counts())[:n]
    return np.flatnonzero(np.arange(k, n + k) <= end)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20, rows: int = 1 << 16):
    """Cut a batch into ranges of about ``limit`` text bytes (one row at least) and at most ``rows`` rows."""
    values = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    sizes = np.diff(np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)) if len(values) else np.zeros(0, np.int64)
    total = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + limit, "right"))))
        yield batch.slice(begin, end - begin)
        begin = end
        tidy()
