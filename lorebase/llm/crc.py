"""CRC-32C of many byte strings at once, and the masked form that record files carry.

The checksum is linear: blocks of 64 bytes give theirs from one table per place, and
blocks of a string are joined pairwise by the tables of "so many zero bytes follow".
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values of the format.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
BLOCK = 64
_ONES = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


@lru_cache(maxsize=64)
def _after(power: int) -> np.ndarray:
    """For each byte of a checksum the tables of 2**power zero bytes that follow."""
    if power:
        half = _after(power - 1)
        return np.stack([_apply(half, t) for t in half])
    single = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    return _bytes()[single & 255] ^ (single >> 8)


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    out = [_bytes()]
    for _ in range(BLOCK - 1):
        out.append(_apply(_after(0), out[-1]))
    return np.stack(out[::-1])


def _front(values: np.ndarray, sizes: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Rows of ``sizes`` values, each filled up with zeros in front to ``wide`` values."""
    out = np.zeros(int(wide.sum()), values.dtype)
    ends = np.cumsum(wide)
    out[np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(len(values))] = values
    return out


def crc32c(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The checksum of each of the strings that lie one after another in ``data`` (bytes)."""
    sizes = np.asarray(sizes, np.int64)
    blocks = -(-sizes // BLOCK)
    cut = _front(data, sizes, blocks * BLOCK).reshape(-1, BLOCK)
    sums = np.zeros(len(cut), np.uint32)
    for place, values in enumerate(_places()):
        sums ^= values[cut[:, place]]
    power, counts = BLOCK.bit_length() - 1, blocks
    while counts.max(initial=0) > 1:
        halves = (counts + 1) // 2
        pairs = _front(sums, counts, halves * 2).reshape(-1, 2)
        sums = _apply(_after(power), pairs[:, 0]) ^ pairs[:, 1]
        power, counts = power + 1, halves
    out = np.zeros(len(sizes), np.uint32)
    out[counts > 0] = sums
    begun = np.full(len(sizes), _ONES, np.uint32)
    for bit in range(int(sizes.max(initial=0)).bit_length()):
        on = (sizes >> bit & 1).astype(bool)
        begun[on] = _apply(_after(bit), begun[on])
    return out ^ begun ^ _ONES


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)
