"""Arrow batches inside Python tasks: cut into pieces of bounded size, freed memory given back.

A batch holds up to 10,000 rows or 64 MB (Spark's settings); what a task makes from it can be many
times as large, so tasks work on one piece at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Bytes of text in a piece (a longer single text is a piece of its own).
PIECE_BYTES = 1 << 20


@lru_cache(maxsize=1)
def thrifty() -> None:
    """In a worker (which Spark uses again for later tasks): buffers of 1 MB and more go back to the
    system as soon as they are freed, Arrow's too."""
    if TaskContext.get() is None:
        return
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # fixed value: M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 << 20)  # fixed value: M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # not this C library
        pass


def bounds(sizes: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """``(first row, end row)`` of runs of rows of at most ``limit`` in all (or of one row)."""
    ends, a = np.cumsum(sizes, dtype=np.int64), 0
    while a < len(ends):
        before = int(ends[a - 1]) if a else 0
        b = max(int(np.searchsorted(ends, before + limit, side="right")), a + 1)
        yield a, b
        a = b


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, in order, with at most ``limit`` bytes of the text ``column`` at a time."""
    thrifty()
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for a, b in bounds(size, limit):
            yield batch.slice(a, b - a)
