"""Operator 2, SimHash near-dedup by anchor-point covering.

Fingerprint: words (white-space separated, A-Z lowered) of the whole text, shingles of
``shingle`` words, XXH64 (seed 42) of each, majority per bit.

Covering: the 64 bits are three thirds (22, 21, 21 bits). If two fingerprints differ in ``t``
bits, the worst third holds at least a third of them, so on some *pair* of thirds they differ
in at most ``t - ceil(t / 3)``. In each third the anchors are the codewords of the binary Golay
code of length 23, a perfect covering code of radius 3; an anchor of a pair of thirds is a
pair of codewords. A fingerprint goes to every anchor within covering radius plus threshold,
counted per third: distance ``3 + e1`` and ``3 + e2`` with ``e1 + e2`` within the pair's
threshold. Its *home* anchor is the one with both distances at most 3 (there is exactly one),
and all fingerprints linked to it also come to that anchor. So comparing homes with all
fingerprints of the anchor finds every link.

Equal fingerprints are one before any of that. Replicas leave a task as packed arrays, one row
a bucket of anchors. Anchors with more than about ``SPLIT`` fingerprints (found on one fingerprint in
``SAMPLE``; this decides only how they are dealt) are dealt as pairs of blocks, each pair on its own, so
no task compares a hot anchor whole. Linked pairs are folded into a local forest as they are found, so
a large group of near copies is never all its pairs, neither in a task's memory nor in its output.

Defined results: null or word-less text has fingerprint 0 and links like any other; fewer words
than a shingle are one shingle; equal rows get the same component; a null ``doc_id`` is never a
component id unless the whole component has none; an empty table gives an empty result; other
columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship_package
from .components import components, local_forest
from .textbytes import LOWER, fresh, mix64, thrifty, with_uid

SEED = 42
#: First bit and width of the thirds; the pairs of thirds that are compared.
THIRDS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Bytes of packed replicas that one bucket should hold, and a replica's bytes.
BUCKET_BYTES = 32 << 20
REPLICA_BYTES = 12
#: Fingerprints in a block of a hot anchor; one fingerprint in ``SAMPLE`` tells which anchors are hot.
SPLIT = 8192
SAMPLE = 64
#: Anchors there are, and by how much one must pass the mean to be hot: so 1 in ``ABOVE`` at most is.
ANCHORS, ABOVE = 3 << 24, 64
#: Copies of hot replicas that a packing task expands at a time.
EXPAND = 1 << 21
#: Fixed value: generator polynomial of the binary Golay code.
GOLAY = 0b110001110101


def simhash(raw: bytes | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (raw or b"").translate(LOWER).split()
    if not words:
        return 0
    k = min(shingle, len(words))
    buf = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:len(words) - k + 1]
    xx = xxhash.xxh64_intdigest
    h = np.fromiter((xx(buf[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1:].tolist())), "<u8", len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` plus ``fp`` (the fingerprint's 64 bits as a signed long), one row per document."""
    src = docs.select(*keys, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text") + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        for b in batches:
            raw = b.column(b.num_columns - 1).cast(pa.binary())
            fp = np.fromiter((simhash(x.as_py(), shingle) for x in raw), np.uint64, len(raw))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*keys, "fp"])

    ship_package(docs.sparkSession)
    return src.mapInArrow(run, schema)


@lru_cache(maxsize=4)
def _cosets(excess: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Remainder of each unit vector; then, for e = 0..excess, the error patterns that take a
    word to a codeword (weight <= 3 for e = 0, 3 + e otherwise) as CSR by remainder."""
    rem = []
    for i in range(23):
        r = 1 << i
        for d in range(i, 10, -1):
            if r >> d & 1:
                r ^= GOLAY << (d - 11)
        rem.append(r)
    rem = np.array(rem, np.int64)
    out = []
    for e in range(excess + 1):
        weights = range(4) if e == 0 else (3 + e,)
        pats = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(23), w)], np.int64)
        syn = syndrome(pats, rem)
        order = np.argsort(syn, kind="stable")
        count = np.bincount(syn, minlength=2048)
        out.append((pats[order], np.concatenate([[0], np.cumsum(count)[:-1]]), count))
    return rem, np.arange(1), out


def syndrome(x: np.ndarray, rem: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator (0 for codewords)."""
    s = np.zeros(len(x), np.int64)
    for i in range(23):
        s ^= np.where(x >> i & 1, rem[i], 0)
    return s


def pair_threshold(max_bits: int) -> int:
    """Differing bits that the best pair of thirds can have at most."""
    return max_bits - ceil(max_bits / 3)


def replicas(fp: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """``(row, anchor, home?)`` arrays: every anchor each fingerprint goes to."""
    t = pair_threshold(max_bits)
    rem, _, classes = _cosets(t)
    third = []
    for at, width in THIRDS:
        x = (fp >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)
        third.append((x, syndrome(x, rem)))
    for p, (i, j) in enumerate(PAIRS):
        (xi, si), (xj, sj) = third[i], third[j]
        for e1 in range(t + 1):
            for e2 in range(t + 1 - e1):
                (pa1, st1, n1), (pa2, st2, n2) = classes[e1], classes[e2]
                inner = n2[sj]
                many = n1[si] * inner
                row = np.repeat(np.arange(len(fp)), many)
                k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                a, b = np.divmod(k, inner[row])
                c1 = xi[row] ^ pa1[st1[si[row]] + a]
                c2 = xj[row] ^ pa2[st2[sj[row]] + b]
                yield row, (p << 24) | (c1 >> 11 << 12) | (c2 >> 11), e1 == e2 == 0


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) % buckets


def _count_anchors(max_bits: int, rows: int = 8192):
    """Sampled fingerprints to (anchor, fingerprints there), by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), rows):
                found = np.concatenate([a for _, a, _ in replicas(every[i:i + rows], max_bits)])
                anchor, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])

    return run


def hot_anchors(distinct: DataFrame, n: int, max_bits: int, split: int, sample: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The hot anchors in order, the blocks of each, and the replicas that dealing adds. Anchors over
    ``split`` are hot; ``packed_replicas`` sets it so that they are 1 in ``ABOVE`` of all codes at most
    (some 800,000 numbers, 13 MB)."""
    none = np.zeros(0, np.int64)
    if n <= split:
        return none, none, 0
    some = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0)
    got = (some.mapInArrow(_count_anchors(max_bits), "anchor long, n long").groupBy("anchor").agg((F.sum("n") * sample).alias("n"))
           .where(F.col("n") > split).orderBy("anchor").toArrow())
    anchor, size = got.column("anchor").to_numpy(), got.column("n").to_numpy()
    blocks = -(-size // split)
    return anchor, blocks, int((size * (blocks - 1)).sum())


def _deal(anchor: np.ndarray, fp: np.ndarray, at: np.ndarray, blocks: np.ndarray, first: np.ndarray):
    """Replicas of hot anchors (number ``at``): slices of ``(replica, pair of blocks)``, every
    replica once a block."""
    many = blocks[at]
    done, i = np.cumsum(many), 0
    own = (mix64(fp) % many.astype(np.uint64)).astype(np.int64)
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + EXPAND, side="right")))
        m = many[i:j]
        who = np.repeat(np.arange(i, j), m)
        other = np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m)
        low, high = np.minimum(own[who], other), np.maximum(own[who], other)
        yield who, first[at[who]] + low * many[who] + high
        i = j


def _pack(buckets: int, max_bits: int, rows: int, hot: tuple[np.ndarray, np.ndarray] | None = None):
    """Fingerprints to rows (bucket, packed anchors, packed fingerprints); a pair of blocks of a hot
    anchor is a bucket of its own, from ``buckets`` on."""

    def packed(where, anchor, values):
        order = np.argsort(where.astype(np.uint16) if buckets < 65536 and where.max(initial=0) < 65536 else where, kind="stable")
        where, anchor, values = where[order], anchor[order], values[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])), len(where))
        for part in range(0, len(cuts) - 1, 64):
            some = range(part, min(part + 64, len(cuts) - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(where[cuts[part:some[-1] + 1]], pa.int64()),
                 pa.array([anchor[cuts[k]:cuts[k + 1]].tobytes() for k in some], pa.binary()),
                 pa.array([values[cuts[k]:cuts[k + 1]].tobytes() for k in some], pa.binary())],
                ["bucket", "anchors", "fps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocks = hot.value if hasattr(hot, "value") else hot or (np.zeros(0, np.int64),) * 2
        first = buckets + np.cumsum(blocks * blocks) - blocks * blocks
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), rows):
                fp = every[i:i + rows]
                anchors, owners = [], []
                for row, anchor, home in replicas(fp, max_bits):
                    anchors.append((anchor | (home << 26)).astype(np.uint32))
                    owners.append(row.astype(np.int32))
                anchor, owner = np.concatenate(anchors), np.concatenate(owners)
                if not len(anchor):
                    continue
                key = (anchor & np.uint32((1 << 26) - 1)).astype(np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    is_hot = known[at] == key
                    there = np.flatnonzero(is_hot)
                    a, f = anchor[there], fp[owner[there]]
                    for who, where in _deal(a, f, at[there], blocks, first):
                        yield from packed(where, a[who], f[who])
                    anchor, owner, key = anchor[~is_hot], owner[~is_hot], key[~is_hot]
                    if not len(key):
                        continue
                yield from packed(_bucket(key, buckets), anchor, fp[owner])

    return run


def links_of_bucket(anchor: np.ndarray, fp: np.ndarray, max_bits: int, pairs: int = 1 << 21):
    """Links among the fingerprints that share an anchor (homes against all), as a local forest
    (folded whenever ``pairs`` links wait)."""
    key = anchor & np.uint32((1 << 26) - 1)
    order = np.argsort(key, kind="stable")
    key, fp, home = key[order], fp[order], (anchor[order] >> np.uint32(26)).astype(bool)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    group = np.repeat(np.arange(len(start)), size)
    homes = np.flatnonzero(home & (size[group] > 1))
    many = size[group[homes]]
    done = np.cumsum(many)
    u = v = np.zeros(0, np.int64)
    us, vs, have, i = [], [], 0, 0
    while i < len(homes):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + pairs, side="right")))
        for lo in range(0, int(many[i:j].max()), pairs):  # one home may have more partners than fit
            n = np.minimum(many[i:j] - lo, pairs).clip(0)
            x = np.repeat(homes[i:j], n)
            k = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            y = start[group[x]] + lo + k
            d = np.bitwise_count(fp[x] ^ fp[y])
            near = (d > 0) & (d <= max_bits)
            us.append(fp[x[near]].view(np.int64))
            vs.append(fp[y[near]].view(np.int64))
            have += len(us[-1])
            if have >= pairs:
                u, v = local_forest(np.concatenate([u, *us]), np.concatenate([v, *vs]))
                us, vs, have = [], [], 0
        i = j
    if have:
        u, v = local_forest(np.concatenate([u, *us]), np.concatenate([v, *vs]))
    return u, v


def _compare(max_bits: int):
    """Bucket rows (sorted by bucket within the partition) to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            a = np.concatenate([np.frombuffer(x, np.uint32) for x, _ in parts])
            f = np.concatenate([np.frombuffer(y, np.uint64) for _, y in parts])
            u, v = links_of_bucket(a, f, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])

        now, parts = None, []
        for b in batches:
            for k, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if k != now and parts:
                    yield flush(parts)
                    parts = []
                now = k
                parts.append((x.as_py(), y.as_py()))
        if parts:
            yield flush(parts)

    return run


def packed_replicas(distinct: DataFrame, n: int, max_bits: int = 4) -> tuple[DataFrame, int]:
    """``distinct(fp)`` (``n`` rows) to packed replicas by bucket, and the partitions they need."""
    spark = distinct.sparkSession
    per_row = 200 if max_bits > 2 else 40
    rows = 8192
    low = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = max(SPLIT, ceil(ABOVE * n * per_row / ANCHORS))  # what is broadcast has a bound at every size
    anchor, blocks, copies = hot_anchors(distinct, n, max_bits, split, SAMPLE)
    buckets = max(low, ceil(n * per_row * REPLICA_BYTES / BUCKET_BYTES))
    hot = spark.sparkContext.broadcast((anchor, blocks)) if len(anchor) else None
    parts = max(spark.sparkContext.defaultParallelism, ceil(n / (8 * rows)))
    packed = (distinct.repartition(parts, "fp")
              .mapInArrow(_pack(buckets, max_bits, rows, hot), "bucket long, anchors binary, fps binary"))
    return packed, max(buckets, ceil((n * per_row + copies) * REPLICA_BYTES / BUCKET_BYTES))


def fingerprint_links(distinct: DataFrame, n: int, max_bits: int = 4) -> DataFrame:
    """``distinct(fp)`` (``n`` rows) to a link table ``(a, b)`` whose components are those of all
    links at ``max_bits`` or fewer differing bits."""
    packed, parts = packed_replicas(distinct, n, max_bits)
    return (packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(_compare(max_bits), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` (``doc_id`` among them), ``fp`` and ``component_id`` of every document."""
    marked = cut(fingerprints(docs, shingle, keys), "fingerprints")
    groups = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint_groups")
    links = fingerprint_links(groups.select("fp"), groups.count(), max_bits)
    comp = components(links).withColumnRenamed("node", "fp")
    with_root = groups.join(comp, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    smallest = with_root.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = with_root.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp")


def hex64(col: str) -> F.Column:
    """A signed long's 64 bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The documents that stay: of each component, the row with the smallest ``doc_id`` (rows
    equal in ``doc_id`` and text, or tied, count as one). Columns as in ``docs``."""
    uid = fresh(docs, "_uid")
    tagged = with_uid(docs, uid)
    found = near_duplicates(tagged, shingle, max_bits, (uid, "doc_id"))
    # without a doc_id in the whole component, its fingerprint stands for it
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    keep = (found.groupBy(group.alias("g"))
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col(uid).alias("u"))).alias("m"))
            .select(F.col("m.u").alias(uid)).distinct())
    return tagged.join(keep, uid, "left_semi").dropDuplicates([uid]).select(*docs.columns)
