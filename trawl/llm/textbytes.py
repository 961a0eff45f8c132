"""Vectorised byte-level text helpers used inside Arrow tasks.

A *shard* is a run of texts as one byte array plus offsets, at most ``SHARD_BYTES`` long
(a longer single text is a shard of its own), so a task's numpy temporaries stay bounded
whatever the Arrow batch holds. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import thrifty

#: Bytes of text that one numpy pass works on.
SHARD_BYTES = 1 << 20

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_NP = np.frombuffer(LOWER, np.uint8)

#: After lower-casing: digits, a-z and every non-ASCII byte belong to a word.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = True
WORD_BYTE[0x61:0x7B] = True
WORD_BYTE[0x80:] = True

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(31))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as ``(data uint8, offsets int64[n + 1])``; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def shards(col: pa.Array, limit: int = SHARD_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into shards: ``(first row, end row, data, offsets)``."""
    thrifty()
    data, off = column_bytes(col)
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def word_spans(low: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of ``table`` bytes (words of lower-cased text); no run crosses a
    text's end."""
    n = len(low)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = table[low]
    before = np.empty(n, bool)
    before[0], before[1:] = False, w[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, w[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span (whole spans; eight bytes a step, vectorised)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    words = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    h = mix64(size.astype(np.uint64) + _C2)
    live, at = np.arange(len(starts)), starts.copy()
    left = size.copy()
    while len(live):
        take = np.minimum(left, 8)
        h[live] = mix64(h[live] ^ (words[at] & _MASK[take]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, text index, start, end)`` of every word of a shard, in text order."""
    low = LOWER_NP[data]
    s, e = word_spans(low, offsets)
    doc = np.searchsorted(offsets, s, side="right") - 1
    return span_hash(low, s, e), doc, s, e


@F.arrow_udf(T.BinaryType())
def zip_text(texts: pa.Array) -> pa.Array:
    """Whole texts as zstandard frames, for a shuffle that carries them (null stays null)."""
    thrifty()
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([None if t is None else pack(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def unzip(frames: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of ``zip_text``'s frames."""
    thrifty()
    unpack = zstandard.ZstdDecompressor().decompress
    return [None if f is None else unpack(f) for f in frames.to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_uid(docs: DataFrame, name: str) -> DataFrame:
    """Add a key made from ``doc_id`` and ``text``: equal rows share it, and it is the same
    whenever a lost task is run again (unlike a running number)."""
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                            F.coalesce(F.col("text"), F.lit(""))))
