"""Operator 3, removal of long repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere else. Sorting every
suffix of a corpus by 400 bytes is out of reach (hundreds of rounds over every byte), so suffixes
are first thinned without loss:

1. Every string's *anchor* is the smallest hashed 16-gram inside it, so equal strings have the
   anchor at the same place. Strings with the same anchor are consecutive: they form a *segment*
   with a *base* (the anchor, or ``HALF`` bytes before it for strings that reach further left),
   and all of them hold the ``HALF`` bytes after the base. Their hash is the segment's key: equal
   strings lie in segments of one key.
2. A segment alone under its key holds no repeated string. Equal segments alone under their key
   are all repeated. Only keys with several different segments remain, each segment once.
3. These segments meet by key. A task deals them to shards, sorts each shard's suffixes from the
   base on (8 bytes a symbol) and keeps the shard's Burrows-Wheeler transform. The transforms are
   merged by refining the interleave: each round sends every suffix, in the order so far, to its
   preceding symbol's place (stably), which sorts by one symbol more; the round in which two
   neighbours part is their common prefix. Nothing is sorted again across shards.
4. For strings that start ``d`` before the base, the intervals of common prefix ``LENGTH - d`` are
   split by the ``d`` bytes before the base; what holds two suffixes is repeated.

A key with more than ``CHUNK`` different segments (a passage that many texts hold, each with
other surroundings) is never one task's work: its suffixes from the base on, each once, are dealt by
ranges of their bytes, merged part by part, and a part's row keeps its order and common prefixes.
What the last suffix of a part shares with the first of the next joins the intervals of neighbouring
parts; only one list of interval names is carried along a key. Strings then leave as rows (interval,
hash of the bytes before the base) that Spark counts over all tasks. So a merging task holds two
chunks of segments at most.

Texts are shuffled once to cut out the segments of step 3 and once to remove bytes, as zstandard
frames.

Defined results: null is empty; texts under ``LENGTH`` bytes keep all; nothing crosses texts;
equal rows repeat each other, so all they have in strings of ``LENGTH`` bytes goes from each; an
empty table gives an empty result; the documents' other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textbytes import fresh, mix64, shards, span_hash, unzip, with_uid, zip_text

LENGTH = 400
GRAM = 16
HALF = 200
#: Segments that one merge works on (a key's segments stay together; a key with more is merged by
#: parts), those of a shard, and the texts that a cutting task remembers.
CHUNK, SHARD, RECENT = 20_000, 2048, 100_000
#: Depths at which strings of a key can be equal from the base on; bits of a place in a part.
DEPTHS, PLACE = np.arange(HALF + 1, LENGTH + 1), 21
_C = np.uint64(0xD1342543DE82EF95)


def gram_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from every position (positions that have 16)."""
    n = len(data) - GRAM + 1
    words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    return mix64(mix64(words[:n] + _C) ^ words[8:8 + n])


def segments(data: np.ndarray, off: np.ndarray, length: int = LENGTH, half: int = HALF):
    """``(text, first start, last start, base)`` of a shard's segments, places in the shard."""
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < length or not (np.diff(off) >= length).any():
        return none
    key = (gram_hash(data) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[:len(key) - (width - have)], key[width - have:])
    size = np.maximum(np.diff(off) - length + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    s = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + off[:-1][text]
    anchor = (key[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    far = anchor - s >= half
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (far[1:] != far[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(s)) - 1
    return text[at], s[at], s[last], anchor[at] - half * far[at]


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text) to a row a segment: its key, its hash and its places in the text."""
    for batch in batches:
        for a, _, data, off in shards(batch.column(1)):
            text, lo, hi, base = segments(data, off)
            if not len(text):
                continue
            key = span_hash(data, base, base + HALF)
            whole = mix64(span_hash(data, lo, hi + LENGTH) + (base - lo).astype(np.uint64))
            start = off[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(text + a)),
                 *(pa.array((x - start).astype(np.int32)) for x in (lo, hi, base))], ["key", "seg", "uid", "lo", "hi", "base"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, zipped text, wanted segments) to the segments' bytes; of repeated rows the first counts."""

    def made(rows):
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "seg", "n", "left", "starts", "data"])

    rows, seen = [], set()
    for batch in batches:
        for uid, raw, want in zip(batch.column(0).to_pylist(), unzip(batch.column(1)), batch.column(2)):
            if uid in seen:
                continue
            if len(seen) >= RECENT:
                seen.clear()
            seen.add(uid)
            for r in want.as_py():
                rows.append((r["key"], r["seg"], r["n"], r["base"] - r["lo"], r["hi"] - r["lo"] + 1, raw[r["lo"]:r["hi"] + LENGTH]))
                if len(rows) == 4096:
                    yield made(rows)
                    rows = []
    if rows:
        yield made(rows)


def symbols(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of 8-byte symbols (zero-padded, order-preserving) and their symbol counts."""
    count = np.array([(len(s) + 7) // 8 for s in strings])
    wide = int(count.max()) if len(count) else 0
    flat = b"".join(s.ljust(8 * wide, b"\0") for s in strings)
    return np.frombuffer(flat, ">u8").reshape(len(strings), wide).astype(np.uint64), count


def shard_bwt(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's transform: for each suffix in sorted order the symbol before it (0 before a whole
    string), and the number of the string a whole suffix belongs to (-1 for others).

    ``ids``: rows of symbol numbers from 1 on, 0 past the end. Suffixes are sorted by prefix
    doubling; equal ones stand in the order of their strings."""
    n, wide = ids.shape
    rank = np.concatenate([ids, np.zeros((n, 1), ids.dtype)], axis=1).astype(np.int64)
    have = 1
    while have < wide + 1:
        ahead = np.zeros_like(rank)
        ahead[:, :-have] = rank[:, have:]
        pair = rank * (int(rank.max()) + 1) + ahead
        rank = np.unique(pair, return_inverse=True)[1].reshape(pair.shape)
        have *= 2
    inside = np.arange(wide + 1)[None, :] <= count[:, None]
    row, at = np.nonzero(inside)
    order = np.lexsort([row, rank[row, at]])
    row, at = row[order], at[order]
    before = np.where(at > 0, ids[row, np.maximum(at - 1, 0)], 0)
    return before, np.where(at == 0, row, -1)


def _stable_order(c: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative numbers: two radix passes of 16 bits."""
    order = np.argsort((c & 0xFFFF).astype(np.uint16), kind="stable")
    if c.max(initial=0) > 0xFFFF:
        order = order[np.argsort((c[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def merge_bwts(bwts: list[np.ndarray], whole: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge shard transforms by refining the interleave.

    Returns the strings (numbered through all shards) in the order of their suffixes, and the
    common prefix in symbols of each with the one before it."""
    size = [len(b) for b in bwts]
    texts = [int((w >= 0).sum()) for w in whole]
    every = np.concatenate(bwts)
    shard = np.repeat(np.arange(len(bwts), dtype=np.uint16), size)
    ends = np.repeat(np.arange(len(bwts), dtype=np.uint16), texts)  # the empty suffixes' interleave never changes
    n = len(every)
    block = np.zeros(n, np.int64)
    common = np.full(n, -1)
    rounds = 0
    while True:
        pointer = np.empty(n, np.int64)
        pointer[np.argsort(shard, kind="stable")] = np.arange(n)  # the next suffix of its shard
        c = every[pointer]
        order = _stable_order(c)
        c, before = c[order], block[order]
        new = np.ones(n, bool)
        new[1:] = (c[1:] != c[:-1]) | (before[1:] != before[:-1])
        new[1:len(ends)] = False
        shard = shard[order]
        shard[:len(ends)] = ends
        fresh_ones = new & (common < 0)
        common[fresh_ones] = rounds
        rounds += 1
        block = np.cumsum(new)
        if not fresh_ones.any():
            break
    common[common < 0] = n  # never parted: equal to the end
    first = np.cumsum([0, *texts[:-1]])
    pointer = np.empty(n, np.int64)
    pointer[np.argsort(shard, kind="stable")] = np.arange(n)
    string = np.concatenate([np.where(w >= 0, w + f, -1) for w, f in zip(whole, first)])[pointer]
    at = np.flatnonzero(string >= 0)
    # between two whole suffixes, the smallest common prefix on the way counts
    path = np.minimum.reduceat(common[:at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
    path[0] = 0
    return string[at], path


def sorted_suffixes(strings: list[bytes], shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """The strings' order, and the bytes each has in common with the one before it."""
    sym, count = symbols(strings)
    ids = np.unique(sym, return_inverse=True)[1].reshape(sym.shape) + 1
    ids[np.arange(sym.shape[1])[None, :] >= count[:, None]] = 0
    made = [shard_bwt(ids[i:i + shard], count[i:i + shard]) for i in range(0, len(strings), shard)]
    order, common = merge_bwts([m[0] for m in made], [m[1] for m in made])
    same = np.minimum(common, sym.shape[1])
    out = 8 * same
    # the bytes that agree within the first symbol that differs
    later = np.flatnonzero(same < sym.shape[1])
    later = later[later > 0]
    x = sym[order[later], same[later]] ^ sym[order[later - 1], same[later]]
    bits = np.zeros(len(x), np.int64)
    for k in range(8):
        bits += (x >> np.uint64(8 * k)) > 0
    out[later] += 8 - bits
    return order, out


def repeated_starts(key: np.ndarray, n: np.ndarray, left: np.ndarray, starts: np.ndarray, data: list[bytes],
                    length: int = LENGTH) -> list[np.ndarray]:
    """Per segment the starts (relative to the base) of its strings that occur again."""
    right = [d[x:] for d, x in zip(data, left.tolist())]
    order, common = sorted_suffixes(right)
    size = np.array([len(d) for d in data])
    flat = np.frombuffer(b"".join(data), np.uint8)
    base = np.cumsum(size) - size + left
    hashed = np.zeros(len(data), np.uint64)
    powers = np.cumprod(np.full(int(left.max(initial=0)) + 1, _C))
    again = [[] for _ in data]
    for d in range(int(left.max(initial=0)) + 1):
        if d:
            ok = left >= d
            hashed[ok] += mix64(flat[base[ok] - d].astype(np.uint64) + _C) * powers[d]
        # strings of this start: base - d, if the segment has it
        here = np.flatnonzero((d <= left) & (d >= left - starts + 1))
        if not len(here):
            continue
        interval = np.empty(len(data), np.int64)
        interval[order] = np.cumsum(common < length - d)
        pair = np.stack([interval[here].astype(np.uint64), hashed[here], key[here].view(np.uint64)])
        label = np.lexsort(pair)
        p = pair[:, label]
        new = np.ones(len(label), bool)
        new[1:] = (p[:, 1:] != p[:, :-1]).any(axis=0)
        group = np.cumsum(new) - 1
        total = np.bincount(group, n[here][label])
        for i in here[label[total[group] >= 2]].tolist():
            again[i].append(-d)
    return [np.array(sorted(a), np.int64) for a in again]


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _ranges(found: list[np.ndarray]) -> pa.Array:
    """Sorted starts to lists of their ranges."""
    out = []
    for s in found:
        edge = np.flatnonzero(np.diff(s) > 1)
        a, b = np.concatenate([s[:1], s[edge + 1]]), np.concatenate([s[edge], s[-1:]])
        out.append([{"a": int(x), "b": int(y)} for x, y in zip(a, b)])
    return pa.array(out, _RUNS)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (sorted by key within the partition) to the ranges of repeated starts."""

    def flush(rows: dict[tuple, tuple]) -> pa.RecordBatch:
        key, seg, n, left, starts, data = zip(*rows.values())
        found = repeated_starts(np.array(key, np.int64), np.array(n), np.array(left), np.array(starts), list(data))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(seg, pa.int64()), _ranges(found)], ["key", "seg", "runs"])

    rows: dict[tuple, tuple] = {}
    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if len(rows) >= CHUNK and row[0] != last:
                yield flush(rows)
                rows = {}
            last = row[0]
            rows.setdefault(row[:2], row)
    if rows:
        yield flush(rows)


def _range_parts(chunk: int):
    """Right-hand strings (sorted by key and bytes) to a row a part of at most ``chunk`` of one key: the
    strings in merged order, the common prefix of each with the one before it, and by depth the
    place where the part's last interval begins."""
    kinds = {"key": pa.int64(), "part": pa.int64(), "first": pa.binary(), "last": pa.binary(), "tail": pa.list_(pa.int32()),
             "rights": pa.list_(pa.binary()), "totals": pa.list_(pa.int64()), "common": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 20

        def flush(key: int, rights: list[bytes], totals: list[int]) -> pa.RecordBatch:
            order, common = sorted_suffixes(rights)
            rights, totals = [rights[i] for i in order], [totals[i] for i in order]
            tail = [int(np.append(0, np.flatnonzero(common[1:] < t) + 1)[-1]) for t in DEPTHS]
            row = (key, part, rights[0], rights[-1], tail, rights, totals, common.tolist())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds.values())], list(kinds))

        now, rights, totals = None, [], []
        for batch in batches:
            for key, right, total in zip(*(c.to_pylist() for c in batch.columns)):
                if rights and (key != now or len(rights) >= chunk):
                    yield flush(now, rights, totals)
                    part, rights, totals = part + 1, [], []
                now = key
                rights.append(right)
                totals.append(total)
        if rights:
            yield flush(now, rights, totals)

    return run


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts (sorted by key and part) to ``key, part, lead``: by depth the name of the interval that the
    part's first string lies in, which earlier parts may have begun. A name is the place of the
    interval's first string; the task holds one list of names."""
    now, before, open_ = None, b"", None
    for batch in batches:
        leads = []
        for key, part, first, last, tail in zip(*(c.to_pylist() for c in batch.columns)):
            lead = np.full(len(DEPTHS), part << PLACE)
            if key == now:
                short = min(len(before), len(first))
                differ = np.flatnonzero(np.frombuffer(before, np.uint8, short) != np.frombuffer(first, np.uint8, short))
                lead = np.where(DEPTHS <= (differ[0] if len(differ) else short), open_, lead)
            at = np.array(tail)
            now, before, open_ = key, last, np.where(at > 0, (part << PLACE) + at, lead)
            leads.append(lead.tolist())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(leads, pa.list_(pa.int64()))], ["key", "part", "lead"])


def _interval_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with their leads to ``key, right, names``: by depth the name of the string's interval,
    -1 where it surely holds one string of one segment that occurs once."""
    for batch in batches:
        for key, part, lead, rights, totals, common in zip(*(c.to_pylist() for c in batch.columns)):
            common, once, at = np.array(common), np.array(totals) == 1, np.arange(len(rights))
            names = np.empty((len(rights), len(DEPTHS)), "<i8")
            for k, t in enumerate(DEPTHS):
                new = common < t
                new[0] = True
                start = np.maximum.accumulate(np.where(new, at, 0))
                alone = new & np.append(new[1:], False) & once & (at > 0)  # the last may go on in the next part
                names[:, k] = np.where(alone, -1, np.where(start > 0, (part << PLACE) + start, lead[k]))
            for i in range(0, len(rights), 1024):
                some = rights[i:i + 1024]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(some), pa.int64()), pa.array(some, pa.binary()),
                     pa.array([row.tobytes() for row in names[i:i + 1024]], pa.binary())], ["key", "right", "names"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their intervals' names to a row a string that may repeat: its place before the
    base, its interval, and the hash of the bytes between them."""
    powers = np.cumprod(np.full(HALF + 1, _C))
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            cols = batch.slice(i, 1024)
            key, seg, n, left, starts = (cols.column(k).to_numpy() for k in range(5))
            of, ds, intervals, hashes = [], [], [], []
            for r, (data, raw) in enumerate(zip(cols.column(5).to_pylist(), cols.column(6).to_pylist())):
                names = np.frombuffer(raw, "<i8")
                d = np.arange(max(left[r] - starts[r] + 1, 0), left[r] + 1)
                name = names[LENGTH - d - DEPTHS[0]]
                d, name = d[name >= 0], name[name >= 0]
                back = np.frombuffer(data, np.uint8)[::-1].astype(np.uint64)
                h = np.append(np.uint64(0), np.cumsum(mix64(back + _C) * powers[1:len(back) + 1]))
                of.append(np.full(len(d), r))
                ds.append(d)
                intervals.append(name)
                hashes.append(h[d])
            of = np.concatenate(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[of]), pa.array(np.concatenate(ds), pa.int32()), pa.array(np.concatenate(intervals), pa.int64()),
                 pa.array(np.concatenate(hashes).view(np.int64)), pa.array(seg[of]), pa.array(n[of])],
                ["key", "d", "interval", "hash", "seg", "n"])


def _found_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seg, places before the base) to the ranges of repeated starts."""
    for batch in batches:
        starts = [np.array(sorted(-d for d in ds), np.int64) for ds in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _ranges(starts)], ["key", "seg", "runs"])


def merged_intervals(rights: DataFrame, chunk: int) -> DataFrame:
    """Different strings ``key, right, total`` of any number a key to ``key, right, names``.

    The strings are dealt by ranges of their bytes, a part's shard transforms are merged as in one
    task, and neighbouring parts are joined by what the last string of one shares with the first of
    the next, carried along the key's parts."""
    parts = max(1, ceil(2 * rights.count() / chunk))
    merged = cut(rights.repartitionByRange(parts, "key", "right").sortWithinPartitions("key", "right").select("key", "right", "total")
                 .mapInArrow(_range_parts(chunk), "key long, part long, first binary, last binary, tail array<int>, "
                             "rights array<binary>, totals array<long>, common array<int>"), "hot_parts")
    lead = (merged.select("key", "part", "first", "last", "tail").repartition("key").sortWithinPartitions("key", "part")
            .mapInArrow(_carry, "key long, part long, lead array<long>"))
    return (merged.join(lead, ["key", "part"]).select("key", "part", "lead", "rights", "totals", "common")
            .mapInArrow(_interval_names, "key long, right binary, names binary"))


def hot_repeats(cut_out: DataFrame, chunk: int) -> DataFrame:
    """Segments of keys with too many for one task to ``key, seg, runs``: their right-hand strings,
    each once, are merged over tasks; strings that start ``d`` before the base are equal if they share
    the interval of depth ``LENGTH - d`` and the ``d`` bytes before the base."""
    segs = cut(cut_out.select("key", "seg", "n", "left", "starts", F.expr("substring(data, 1, left)").alias("before"),
                              F.expr("substring(data, left + 1)").alias("right")), "hot_segments")
    rights = cut(segs.groupBy("key", "right").agg(F.sum("n").alias("total")), "hot_rights")
    named = cut(merged_intervals(rights, chunk), "hot_intervals")
    strings = cut(segs.join(named, ["key", "right"]).select("key", "seg", "n", "left", "starts", "before", "names")
                  .mapInArrow(_strings, "key long, d int, interval long, hash long, seg long, n long"), "hot_strings")
    same = ["key", "d", "interval", "hash"]
    # repeated rows can bring a segment twice, so rows are not counted
    again = cut(strings.groupBy(*same).agg(F.max("n").alias("n"), F.min("seg").alias("a"), F.max("seg").alias("b"))
                .where("n > 1 or a <> b").select(*same), "hot_again")
    return (strings.join(again, same).groupBy("key", "seg").agg(F.collect_set("d").alias("ds"))
            .mapInArrow(_found_ranges, "key long, seg long, runs array<struct<a: int, b: int>>"))


def repeated_spans(docs: DataFrame, uid: str) -> DataFrame:
    """``(uid, spans)``: the byte ranges that go (start and end, unmerged), by document key."""
    spark = docs.sparkSession
    src = docs.select(F.col(uid).alias("uid"), "text")
    places = cut(src.mapInArrow(_segment_rows, "key long, seg long, uid long, lo int, hi int, base int"), "segments")
    groups = cut(places.groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(F.struct("uid", "lo", "hi", "base")).alias("at")), "segment_groups")
    keys = groups.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    alike = groups.join(keys.where("kinds = 1"), "key").select(
        "key", "seg", F.array(F.struct((F.col("at.lo") - F.col("at.base")).alias("a"), (F.col("at.hi") - F.col("at.base")).alias("b"))).alias("runs"))
    mixed = groups.join(keys.where("kinds > 1").select("key", (F.col("kinds") > CHUNK).alias("hot")), "key").select("key", "seg", "n", "at.*", "hot")
    wanted = cut(mixed.groupBy("uid", "hot").agg(F.collect_list(F.struct("key", "seg", "n", "lo", "hi", "base")).alias("want"), F.count("*").alias("m")), "segments_wanted")
    many, hot = wanted.agg(F.coalesce(F.sum(F.when(F.col("hot"), 0).otherwise(F.col("m"))), F.lit(0)), F.coalesce(F.max("hot"), F.lit(False))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(many / CHUNK))
    zipped = src.select("uid", zip_text("text").alias("text"))

    def segment_bytes(of):
        return (zipped.join(wanted.where(of).select("uid", "want"), "uid").select("uid", "text", "want")
                .mapInArrow(_cut_out, "key long, seg long, n long, left int, starts int, data binary"))

    found = (segment_bytes("not hot").repartition(parts, "key").sortWithinPartitions("key")
             .mapInArrow(_merge, "key long, seg long, runs array<struct<a: int, b: int>>").where(F.size("runs") > 0))
    if hot:
        found = found.union(hot_repeats(segment_bytes("hot"), CHUNK))
    gone = cut(found.union(alike), "segments_repeated")
    hit = places.join(gone, ["key", "seg"]).select("uid", F.explode(F.transform("runs", lambda r: F.struct(
        (r["a"] + F.col("base")).alias("start"), (r["b"] + F.col("base") + LENGTH).alias("end")))).alias("span"))
    return hit.groupBy("uid").agg(F.collect_set("span").alias("spans"))


def _strip(names: list[str], with_text: bool):
    """(zipped text, spans, rest...) to (rest..., [text,] bytes, merged spans, kept bytes)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unzip(batch.column(0))
            size, merged, kept = [], [], []
            for raw, spans in zip(texts, batch.column(1).to_pylist()):
                raw, out, keep, last = raw or b"", [], [], 0
                for s in sorted((s["start"], s["end"]) for s in spans or ()):
                    if out and s[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], s[1])
                    else:
                        out.append(list(s))
                for a, b in out:
                    keep.append(raw[last:a])
                    last = b
                size.append(len(raw))
                merged.append([{"start": a, "end": b} for a, b in out])
                kept.append(b"".join([*keep, raw[last:]]))
            text = [pa.array(texts, pa.binary()).cast(pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *text, pa.array(size, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())], names)

    return run


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, name: str = "repeats") -> DataFrame:
    """The columns ``keep`` (all by default) with a struct column: ``n_bytes``, ``spans`` (maximal
    removed ranges), ``kept`` (the remaining bytes). Texts cross the shuffle as zstandard frames."""
    keep = docs.columns if keep is None else keep
    uid, name = fresh(docs, "_uid"), fresh(docs, name)
    tagged = with_uid(docs, uid)
    spans = repeated_spans(tagged, uid).select(F.col("uid").alias(uid), F.col("spans").alias(name))
    rest = [c for c in keep if c != "text"]
    parts = [fresh(docs, f"_{c}") for c in ("n_bytes", "spans", "kept")]
    text = ["text"] if "text" in keep else []
    src = tagged.select(uid, zip_text("text").alias("text"), *rest).join(spans, uid, "left").select("text", name, *rest)
    kinds = dict(docs.dtypes)
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*rest, *text]), f"`{parts[0]}` long",
                     f"`{parts[1]}` array<struct<start: int, end: int>>", f"`{parts[2]}` binary"])
    out = src.mapInArrow(_strip([*rest, *text, *parts], bool(text)), ddl)
    return out.select(*keep, F.struct(*(F.col(p).alias(c) for p, c in zip(parts, ("n_bytes", "spans", "kept")))).alias(name))


#: DuckDB: every 400-byte string by its hash, starts of those that occur twice merged to runs.
ORACLE = f"""
with d as materialized (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
w as (select r, b, unnest(range(0, octet_length(b) - {LENGTH - 1})) as s from d),
h as materialized (select r, s, md5(b[s + 1:s + {LENGTH}]) as m from w),
again as (select r, s from h where m in (select m from h group by m having count(*) > 1)),
edge as (select r, s, case when s - lag(s) over (partition by r order by s) <= {LENGTH} then 0 else 1 end as fresh from again),
run as (select r, s, sum(fresh) over (partition by r order by s) as k from edge),
span as (select r, min(s) as a, max(s) + {LENGTH} as z from run group by r, k),
gap as (select r, a, z, coalesce(lag(z) over (partition by r order by a), 0) as before from span),
cutout as (select r, count(*) as n_spans, sum(z - a) as n_removed, max(z) as last from span group by r),
lead_in as (select g.r, string_agg(hex(d.b[g.before + 1:g.a]), '' order by g.a) as x from gap g join d using (r) group by g.r)
select d.doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(x, '') || hex(b[coalesce(last, 0) + 1:octet_length(b)]))) as kept_sha256
from d left join cutout using (r) left join lead_in using (r)"""
