"""Batches of texts in slices: a Python worker holds what it makes of a few texts, not of a whole batch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa

#: Characters of text in a slice, and rows, about.
SLICE_TEXT, SLICE_ROWS = 2 << 20, 4096
try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
    pa.set_memory_pool(pa.system_memory_pool())  # batches too go back to the system when they are freed
except (OSError, AttributeError):  # another C library
    _TRIM = None


def slices(texts: pd.Series) -> Iterator[pd.Series]:
    """``texts`` in order, cut after ``SLICE_TEXT`` characters or ``SLICE_ROWS`` rows; what a slice took is given back to the system after it."""
    ends = texts.str.len().fillna(0).cumsum().to_numpy() if len(texts) else []
    begin = 0
    while begin < len(texts):
        done = ends[begin - 1] if begin else 0
        end = min(begin + SLICE_ROWS, max(begin + 1, int(ends.searchsorted(done + SLICE_TEXT, "right"))))
        yield texts.iloc[begin:end]
        begin = end
        if _TRIM is not None:
            _TRIM(0)
