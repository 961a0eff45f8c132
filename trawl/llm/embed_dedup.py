"""Operator 10, embedding near-dedup by cross-polytope hashing.

Rotation: three rounds of random signs and a fast Hadamard transform (vectors padded to a power
of two). A hash is the signed axis that the rotated vector leans to most; a table's bucket joins
``HASHES`` of them. Multiprobe: a vector also goes to the buckets in which one of its hashes is
replaced by its second-best axis. In a bucket, vectors at home are compared with all there, by
cosine in double precision; only pairs at the threshold or above link, so no link is false.

Equal vectors of a label are one *representative* with a multiplicity before hashing. Buckets
with more than ``SPLIT`` members are dealt as pairs of blocks, and the tasks are as many as the
dealt rows need; a task takes them group by group. A pair that meets in several buckets counts once: in its first table, which both sides'
codes tell. Linked pairs are folded into counts and a local forest chunk by chunk, so neither is a task's
memory nor its output all pairs.

Recall against brute force is measured in the tests (1.0 on the given tables).

Defined results: a vector that is null, zero, holds null or non-finite components, or has a null
label links with nothing: 0 links, its own component, kept. Vectors of different lengths never
link. Equal rows link with each other. An empty table gives an empty result. Other columns of
the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components, local_forest

TABLES = 8
HASHES = 2
#: Codes of a table: the home bucket, then a probe for each hash.
CODES = 1 + HASHES
SPLIT = 4096
#: Replicated rows that one comparing task should hold.
TASK_ROWS = 100_000


@lru_cache(maxsize=8)
def _signs(dim: int) -> np.ndarray:
    return np.random.default_rng(20_000 + dim).choice([-1.0, 1.0], size=(TABLES * HASHES, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row (length a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray) -> np.ndarray:
    """Bucket codes ``(rows, TABLES * CODES)`` of unit vectors: home, then the probes."""
    n, d = x.shape
    dim = max(2, 1 << (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, dim - d)))
    out = np.empty((n, TABLES, CODES), np.int64)
    rows = np.arange(n)
    for t in range(TABLES):
        best, second = [], []
        for k in range(HASHES):
            y = x
            for s in _signs(dim)[t * HASHES + k]:
                y = hadamard(y * s)
            a = np.abs(y)
            top = np.argpartition(a, dim - 2, axis=1)[:, -2:]
            swap = a[rows, top[:, 0]] > a[rows, top[:, 1]]
            first = np.where(swap, top[:, 0], top[:, 1])
            other = np.where(swap, top[:, 1], top[:, 0])
            best.append(2 * first + (y[rows, first] < 0))
            second.append(2 * other + (y[rows, other] < 0))
        for probe in range(CODES):
            code = np.zeros(n, np.int64)
            for k in range(HASHES):
                code = code * (2 * dim) + (second[k] if probe == k + 1 else best[k])
            out[:, t, probe] = code
    return out.reshape(n, -1)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, label, n, embedding) to (rid, label, n, dim, unit vector's bytes, codes)."""
    for b in batches:
        rid, label, n = b.column(0), b.column(1), b.column(2)
        lists = b.column(3)
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        start = np.concatenate([[0], np.cumsum(size)])
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            x = flat[start[rows][:, None] + np.arange(d)]
            x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny and huge components stay in range
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            for i in range(0, len(rows), 4096):
                part, at = x[i:i + 4096], pa.array(rows[i:i + 4096])
                c = codes(part)
                flat_codes = pa.array(c.ravel())
                yield pa.RecordBatch.from_arrays(
                    [rid.take(at), label.take(at), n.take(at), pa.array(np.full(len(part), d), pa.int32()),
                     pa.array([v.tobytes() for v in part], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * c.shape[1], pa.int32()), flat_codes)],
                    ["rid", "label", "n", "dim", "unit", "codes"])


def _meet(cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pair and table: do they meet at x's home, at y's home?"""
    at_x = (cy == cx[:, :, :1]).any(axis=2)
    at_y = (cx == cy[:, :, :1]).any(axis=2)
    return at_x, at_y


def compare_groups(key: np.ndarray, block: np.ndarray, cross: np.ndarray, home: np.ndarray, table: np.ndarray,
                   bucket: np.ndarray, rid: np.ndarray, n: np.ndarray, unit: np.ndarray, code: np.ndarray,
                   threshold: float, cells: int = 1 << 22, links: int = 1 << 19):
    """Rows sorted by ``key``: links within each group, each pair in one place only.

    Chunks of pairs (``cells`` numbers a side) are folded at once, ``links`` pairs at a time: returns
    ``(rid, its links)`` and a local forest ``(node, root)``, never the pairs."""
    pairs = max(1, cells // max(unit.shape[1], TABLES * CODES))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    group = np.repeat(np.arange(len(start)), size)
    homes = np.flatnonzero(home & (size[group] > 1))
    many = size[group[homes]]
    who, at = np.unique(rid, return_inverse=True)
    counts = np.zeros(len(who), np.int64)
    forest = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    have = 0

    def fold():
        x, y = (np.concatenate(c) for c in zip(*waiting))
        np.add.at(counts, at[x], n[y])
        np.add.at(counts, at[y], n[x])
        waiting.clear()
        return local_forest(np.concatenate([forest[0], at[x]]), np.concatenate([forest[1], at[y]]))

    done, i = np.cumsum(many), 0
    while i < len(homes):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + pairs, side="right")))
        for lo in range(0, int(many[i:j].max()), pairs):
            m = np.minimum(many[i:j] - lo, pairs).clip(0)
            x = np.repeat(homes[i:j], m)
            k = np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
            y = start[group[x]] + lo + k
            ok = (rid[x] != rid[y]) & ~(home[y] & (y < x)) & ~(cross[x] & (block[x] == block[y]))
            x, y = x[ok], y[ok]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[near], y[near]
            if not len(x):
                continue
            at_x, at_y = _meet(code[x], code[y])
            t, rows = table[x], np.arange(len(x))
            met = at_x | at_y
            first = met.argmax(axis=1) == t
            hx, hy = code[x, t, 0], code[y, t, 0]
            place = np.where(at_x[rows, t] & at_y[rows, t], np.minimum(hx, hy), np.where(at_x[rows, t], hx, hy))
            here = first & (place == bucket[x])
            waiting.append((x[here], y[here]))
            have += int(here.sum())
            if have >= links:
                forest, have = fold(), 0
        i = j
    if have:
        forest = fold()
    linked = np.flatnonzero(counts)
    return who[linked], counts[linked], who[forest[0]], who[forest[1]]


#: What places a row; the rows of a place (and pair of blocks) are compared.
PLACE = ("label", "dim", "tbl", "bucket", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``PLACE`` to tables of whole groups (of one dimension) and the groups' numbers;
    no more than a batch and a group is held."""

    def numbered(part):
        cols = [part.column(c).to_numpy() for c in PLACE]
        new = np.ones(part.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        return np.cumsum(new), cols[1]

    def whole(part, number, dim):
        edge = np.flatnonzero(np.diff(dim)) + 1
        for a, b in zip([0, *edge], [*edge, part.num_rows]):
            yield part.slice(a, b - a), number[a:b]

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        number, dim = numbered(held)
        last = int(np.searchsorted(number, number[-1]))
        if last:
            yield from whole(held.slice(0, last), number[:last], dim[:last])
            held = held.slice(last)
    if held is not None:
        yield from whole(held, *numbered(held))


def _compare(threshold: float, most: int = TASK_ROWS):
    """Dealt rows (sorted by ``PLACE`` within the partition) to link counts and forests, which are
    folded over the task and leave it whenever they have more than ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        who, links, u, v = none, none, none, none

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([who, u])), pa.array(np.concatenate([links, np.zeros(len(u), np.int64)])),
                 pa.array(np.concatenate([who, v]))], ["rid", "links", "root"])

        for part, number in _groups(batches):
            get = lambda name: part.column(name).to_numpy()  # noqa: E731, B023
            unit = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(len(number), -1)
            code = part.column("codes").combine_chunks().flatten().to_numpy().reshape(len(number), TABLES, CODES)
            w, c, a, b = compare_groups(number, get("block"), get("i") != get("j"), get("probe") == 0, get("tbl"), get("bucket"),
                                        get("rid"), get("n"), unit, code, threshold)
            if not len(w):
                continue
            who, at = np.unique(np.concatenate([who, w]), return_inverse=True)
            total = np.zeros(len(who), np.int64)
            np.add.at(total, at, np.concatenate([links, c]))
            links = total
            u, v = local_forest(np.concatenate([u, a]), np.concatenate([v, b]))
            if len(who) + len(u) > most:
                yield out()
                who, links, u, v = none, none, none, none
        if len(who):
            yield out()

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``;
    ``label`` may be of any type."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    alive = (F.col("label").isNotNull() & e.isNotNull() & ~F.coalesce(bad, F.lit(True))
             & F.coalesce(F.exists(e, lambda c: c != 0), F.lit(False)))
    rows = vectors.select("vec_id", "label", "embedding")
    reps = cut(rows.where(alive).groupBy("label", "embedding")
               .agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
               .withColumn("rid", F.monotonically_increasing_id()), "vector_groups")  # fixed once written
    kind = dict(reps.dtypes)["label"]
    tasks = max(spark.sparkContext.defaultParallelism, ceil(reps.count() / TASK_ROWS))
    hashed = cut(reps.select("rid", "label", "n", "embedding").repartition(tasks, "rid")
                 .mapInArrow(_hash, f"rid long, label {kind}, n long, dim int, unit binary, codes array<long>"), "vector_codes")
    many = hashed.count()
    spread = hashed.select("rid", "label", "n", "dim", "unit", "codes", F.posexplode("codes").alias("pos", "bucket"))
    spread = spread.withColumns({"tbl": (F.col("pos") / CODES).cast("long"), "probe": F.col("pos") % CODES}).drop("pos")
    place = ["label", "dim", "tbl", "bucket"]
    hot = cut(spread.groupBy(*place).count().where(F.col("count") > SPLIT)
              .select(*place, F.ceil(F.col("count") / SPLIT).alias("blocks"), "count"), "hot_buckets")
    copies = hot.agg(F.coalesce(F.sum(F.col("count") * (F.col("blocks") - 1)), F.lit(0))).first()[0]
    hot = hot.drop("count")
    dealt = (spread.join(hot, place, "left")
             .withColumn("block", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("blocks")), F.lit(0)))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks") - 1, F.lit(0)).cast("long"))))
             .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks"))
    # every row of a hot bucket comes once a block
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil((many * TABLES * CODES + copies) / TASK_ROWS))
    found = cut(dealt.repartition(parts, *PLACE).sortWithinPartitions(*PLACE)
                .mapInArrow(_compare(threshold), "rid long, links long, root long"), "vector_links")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    comp = components(found.where("rid <> root"), "rid", "root").withColumnRenamed("node", "rid")
    full = (reps.join(counts, "rid", "left").join(comp, "rid", "left")
            .withColumn("component", F.coalesce("component", "rid")))
    least = full.groupBy("component").agg(F.min("first").alias("component_id"))
    per_rep = full.join(least, "component").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(per_rep, ["label", "embedding"], "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      comp_id.alias("component_id"), F.col("vec_id").eqNullSafe(comp_id).alias("kept"))


ORACLE = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id a, vec_id b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a vec_id, min(b) component_id from reach group by a),
cnt as (select a vec_id, count(*) n from links group by a)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept
from embeddings left join cnt using (vec_id) left join comp using (vec_id)
"""
