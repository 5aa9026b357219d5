"""Blocks of rows, and asking buckets of hashes about their totals.

Operators that compare a corpus with itself work on blocks: rows dealt out by a hash
of key and text, a few megabytes each.  A block reduces its rows to distinct hashes
before anything is shuffled, so a word, line or copy that a third of all rows share
is one entry per block.  Entries go to buckets by the top bits of their hash; as the
number of buckets grows with the input, a bucket stays about as large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, and in a bucket's share, about; and how many there are at least.
BLOCK_TEXT, BUCKET_TEXT, LEAST_BLOCKS = 6 << 20, 32 << 20, 8
#: Bits of a hash that an entry carries where a collision only costs time.
SHORT_BITS = 48


def text_size(df: DataFrame, column: str) -> int:
    """Bytes of text, measured by a pass over the column: no estimate of the optimiser is used."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)


def block_count(size: int, share: int = BLOCK_TEXT) -> int:
    return max(LEAST_BLOCKS, -(-size // share))


def bucket_count(size: int) -> int:
    """Buckets are counted apart from blocks: fewer and larger, so a (block, bucket) row stays long."""
    return block_count(size, BUCKET_TEXT)


def block_of(blocks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")


def bucket_bounds(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of ascending hashes begins, and the end."""
    edges = np.array([(i << 32) // buckets << 32 for i in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(ordered, edges), len(ordered)].astype(np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 as planes of their bytes, as many as the largest needs: shuffles compress them well."""
    wide = numbers.astype("<u8")
    width = (int(wide.max()).bit_length() + 7) // 8 if len(wide) else 0
    return bytes([width]) + np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() + (len(wide).to_bytes(8, "little") if not width else b"")


def unpacked(data: memoryview) -> np.ndarray:
    width = data[0]
    if not width:
        return np.zeros(int.from_bytes(data[1:9], "little"), np.int64)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<i8").ravel()


def low_bytes(ordered: np.ndarray, bits: int = 64) -> bytes:
    """Ascending hashes as the steps between their first ``bits`` bits."""
    short = ordered >> np.uint64(64 - bits)
    return short[:1].astype("<u8").tobytes() + packed(np.diff(short)) if len(short) else b""


def from_low(data: memoryview) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.uint64)
    first = np.frombuffer(data[:8], "<u8")
    return np.cumsum(np.concatenate([first, unpacked(data[8:]).view(np.uint64)]), dtype=np.uint64)


def buffers(column: pa.ChunkedArray | pa.Array) -> list[memoryview]:
    """The values of a binary column without copies."""
    return [memoryview(x.as_buffer()) for x in column]


def scattered(total: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    return [packed(x) for x in np.split(total, cuts)]
