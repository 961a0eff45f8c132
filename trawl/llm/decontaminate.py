"""Operator 1, benchmark decontamination with suffix arrays of the training text.

Every task cuts its documents into shards and builds, per shard, a suffix array over words
(suffixes compared up to the window length). All suffixes of the test items are then binary
searched in it, all at once: a suffix's interval is narrowed one word at a time. Neighbouring
hits on one diagonal (same item, same shift) join to the longest verbatim match, reported with
its place in the item and in the document. A document with any match is contaminated.

Before sorting, the shard's suffixes are thinned to those whose first words begin some test
window; the others can't hold a window, so nothing is lost.

The documents are never shuffled. Test items go to the tasks in blocks of at most
``BLOCK_BYTES`` text (one longer item is a block of its own); each further block is one more
narrow pass over the same rows, whose matches so far are written first: one block's index is live at
a time, however many items there are.

Defined results: null or word-less text has no words and no match; an item without words or
with a null id is left out; an item shorter than the window is one window of its own length;
equal rows are judged alike; an empty table gives an empty result; the documents' own columns
pass through, and the result is one struct column whose name doesn't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship_package
from .textbytes import LOWER, LOWER_NP, column_bytes, fresh, mix64, shards, span_hash, text_words, word_spans

WINDOW = 10
#: Text bytes of the test items that are broadcast at once.
BLOCK_BYTES = 16 << 20
_MUL = np.uint64(0xD6E8FEB86659FD93)

MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])
RESULT = pa.struct([("n_words", pa.int64()), ("matches", pa.list_(MATCH))])
RESULT_DDL = "struct<n_words: bigint, matches: array<struct<item: string, item_word: int, doc_word: int, words: int>>>"


class Tests:
    """The words of a block of test items, and the starts of all its windows."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        col = pa.array([t for _, t in items], pa.string())
        data, off = column_bytes(col)
        low = LOWER_NP[data]
        s, e = word_spans(low, off)
        self.words = span_hash(low, s, e)
        owner = np.searchsorted(off, s, side="right") - 1
        n = np.bincount(owner, minlength=len(items))
        first = np.cumsum(n) - n
        at = np.arange(len(s)) - first[owner]
        size = np.minimum(n, window)[owner]
        ok = at + size <= n[owner]
        self.names = [i for i, _ in items]
        self.start, self.item, self.at, self.size = np.flatnonzero(ok), owner[ok], at[ok], size[ok]
        self.window = window
        self.seed = int(min(4, self.size.min())) if len(self.size) else 0
        if self.seed:
            self.seeds = np.unique(seed_hash(self.words, self.seed)[self.start])
            self.bits = np.zeros(1 << 22, bool)
            self.bits[self.seeds & np.uint64((1 << 22) - 1)] = True
        # equal windows are searched once
        keys = window_hash(self.words, self.start, self.size)
        _, self.pick, self.back = np.unique(keys, return_index=True, return_inverse=True)


def seed_hash(words: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words from every position (short at the end: padded with zero)."""
    padded = np.concatenate([words, np.zeros(q, np.uint64)])
    h = np.zeros(len(words), np.uint64)
    for k in range(q):
        h = h * _MUL + padded[k:k + len(words)]
    return mix64(h)


def window_hash(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = size.astype(np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        live = size > k
        h[live] = h[live] * _MUL + words[start[live] + k]
    return mix64(h)


def _bound(words, order, lo, hi, depth, value, right: bool):
    """First place in [lo, hi) of the suffix order whose word at ``depth`` is >= (or >) value."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        live = lo < hi
        if not live.any():
            return lo
        mid = (lo + hi) >> 1
        w = words[order[np.minimum(mid, len(order) - 1)] + depth]
        up = live & ((w <= value) if right else (w < value))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(live & ~up, mid, hi)


def search(words: np.ndarray, doc_of: np.ndarray, tests: Tests):
    """Every window of the tests in one shard: ``(position, test window index)`` arrays.

    ``words`` ends each document with a zero, which no test word equals (hash 0 is remapped)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not tests.seed or not len(words):
        return none
    seeds = seed_hash(words, tests.seed)
    live = np.flatnonzero(tests.bits[seeds & np.uint64((1 << 22) - 1)])
    at = np.searchsorted(tests.seeds, seeds[live])
    live = live[tests.seeds[np.minimum(at, len(tests.seeds) - 1)] == seeds[live]]
    if not len(live):
        return none
    depth = int(tests.size.max())
    padded = np.concatenate([words, np.zeros(depth, np.uint64)])
    order = live[np.lexsort([padded[live + k] for k in range(depth - 1, -1, -1)])]  # the suffix array
    start, size = tests.start[tests.pick], tests.size[tests.pick]
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    for k in range(depth):
        going = np.flatnonzero((size > k) & (lo < hi))
        if not len(going):
            break
        value = tests.words[start[going] + k]
        a = _bound(padded, order, lo[going], hi[going], k, value, False)
        b = _bound(padded, order, a, hi[going], k, value, True)
        lo[going], hi[going] = a, b
    many = (hi - lo)[tests.back]
    t = np.repeat(np.arange(len(tests.start)), many)
    k = np.arange(len(t)) - np.repeat(np.cumsum(many) - many, many)
    return order[lo[tests.back][t] + k], t


def shard_matches(data: np.ndarray, off: np.ndarray, tests: Tests):
    """Per text its word count; the longest matches as (text, item, item word, text word, words)."""
    h, doc, _, _ = text_words(data, off)
    n_docs = len(off) - 1
    h[h == 0] = 1
    n = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n) - n
    words = np.zeros(len(h) + n_docs, np.uint64)
    words[np.arange(len(h)) + doc] = h
    head = first + np.arange(n_docs)
    pos, t = search(words, doc, tests)
    if not len(pos):
        z = np.zeros(0, np.int64)
        return n, (z, z, z, z, z)
    owner = np.searchsorted(head, pos, side="right") - 1
    item = tests.item[t]
    shift = pos - tests.start[t]
    order = np.lexsort([pos, shift, item])
    pos, t, item, owner, shift = (x[order] for x in (pos, t, item, owner, shift))
    new = np.ones(len(pos), bool)
    new[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (pos[1:] != pos[:-1] + 1) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(pos)))
    return n, (owner[at], item[at], tests.at[t[at]], (pos - head[owner])[at], run + tests.size[t[at]] - 1)


def _scan(tests: Tests, have: bool):
    """Pass over record batches; ``have``: the last column holds the matches of earlier blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for a, b, data, off in shards(text):
                n, (owner, item, item_word, doc_word, words) = shard_matches(data, off, tests)
                order = np.argsort(owner, kind="stable")
                names = pa.array([tests.names[i] for i in item[order].tolist()], pa.string())
                found = pa.StructArray.from_arrays(
                    [names, *(pa.array(x[order], pa.int32()) for x in (item_word, doc_word, words))], fields=list(MATCH))
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))])
                if have:
                    old = batch.column(batch.num_columns - 1).slice(a, b - a).to_pylist()
                    new = found.to_pylist()
                    lists = pa.array([o["matches"] + new[x:y] for o, x, y in zip(old, ends[:-1], ends[1:])], pa.list_(MATCH))
                else:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
                result = pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists.cast(pa.list_(MATCH))], fields=list(RESULT))
                part = batch.slice(a, b - a)
                keep = part.columns[:-1] if have else part.columns
                yield pa.RecordBatch.from_arrays([*keep, result], [str(i) for i in range(len(keep) + 1)])

    return run


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The test items in bounded blocks (one partition of them is read at a time)."""
    now, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null")
    for item, text in rows.toLocalIterator():
        n = len(text.encode())
        if now and size + n > limit:
            yield now
            now, size = [], 0
        now.append((item, text))
        size += n
    yield now


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                 result: str = "match") -> DataFrame:
    """``docs`` with one struct column more (``result``, made fresh if taken): ``n_words`` and
    ``matches`` (item, word in the item, word in the document, length in words)."""
    ship_package(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    result = fresh(docs, result)
    rest = [c for c in docs.columns if c != "text"]
    out = docs.select("text", *rest)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + f", `{result}` {RESULT_DDL}"
    names = [*out.columns, result]
    sent = None
    for i, block in enumerate(blocks(benchmark, block_bytes)):
        if i:  # the index of one block is live at a time
            out = cut(out, "matches")
            sent.unpersist()
        sent = sc.broadcast(Tests(block, window))
        out = out.mapInArrow(_named(sent, i > 0, names), ddl)
    return out.select(*docs.columns, result)


def _named(sent, have: bool, names: list[str]):
    def run(batches):
        for b in _scan(sent.value, have)(batches):
            yield b.rename_columns(names)

    return run


def n_hit(matches: str) -> Column:
    """Words inside any match: the union of the matches' ranges."""
    ranges = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("s"), (m["doc_word"] + m["words"]).alias("e"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(ranges, zero, lambda a, m: F.struct(
        F.greatest(a["end"], m["e"]).alias("end"),
        (a["n"] + F.greatest(m["e"] - F.greatest(a["end"], m["s"]), F.lit(0))).alias("n")))["n"]


def items_of(matches: str) -> Column:
    """The distinct item ids, sorted as strings."""
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item"])))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a match; columns as in ``docs``."""
    name = fresh(docs, "match")
    found = find_matches(docs, benchmark, window, result=name)
    return found.where(F.size(F.col(name)["matches"]) == 0).select(*docs.columns)


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark),
wi as (
  select distinct cast(item_id as varchar) item, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') k
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
dw as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from wi))),
hit as (select doc_id, dw.i, dw.n, item from dw join wi on dw.n = wi.n and dw.k = wi.k),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s
        from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join its using (doc_id)
"""
