"""Hashed-text features and the small linear fits that several operators share.

Two feature maps over whole texts, both vectorised per shard:

* *trigram means*: every byte trigram (A-Z lowered) is a hashed feature, its value the share of
  the text's trigrams (times ``SCALE``). A text's score is then a mean of looked-up weights.
* *token sets*: every word and its prefixes of 4 to 8 bytes; whether it is there, there twice,
  and whether it makes up 0.5 % or 2 % of the text's words (four levels of a hashed token).

Fits run in one task over a bounded sample (the bound is a parameter of each operator); scoring
covers every text and broadcasts only the weights, whose size is fixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .textbytes import LOWER_NP, fresh, shards, span_hash, word_spans

TRIGRAM_BITS = 16
TOKEN_BITS = 18
LEVELS = 4
#: Features of the token sets: a token's level ``l`` is ``l << TOKEN_BITS | token``.
TOKEN_WIDTH = LEVELS << TOKEN_BITS
SCALE = 30.0


#: Entries of sparse rows that one step of a product works on.
STEP = 1 << 20


class Rows:
    """Sparse rows: ``idx[ptr[i]:ptr[i + 1]]`` with values ``val``."""

    def __init__(self, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray):
        self.ptr, self.idx, self.val = ptr, idx, val

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1, dtype=np.int32), np.diff(self.ptr))

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def keep(self, columns: np.ndarray) -> Rows:
        """Only the columns where the mask holds (numbering unchanged)."""
        ok = columns[self.idx]
        ptr = np.concatenate([[0], np.cumsum(np.bincount(self.row[ok], minlength=len(self)))])
        return Rows(ptr, self.idx[ok], self.val[ok])

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.ptr)[rows]
        ptr = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.ptr[rows], size) + np.arange(ptr[-1]) - np.repeat(ptr[:-1], size)
        return Rows(ptr, self.idx[at], self.val[at])

    def _sum(self, to: np.ndarray, of: np.ndarray, by: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((width, of.shape[1]))
        for a in range(0, len(to), STEP):  # temporaries stay small
            part = slice(a, a + STEP)
            for k in range(of.shape[1]):
                out[:, k] += np.bincount(to[part], self.val[part] * of[by[part], k], width)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Rows times the columns of ``w`` (features, k)."""
        return self._sum(self.row, w, self.idx, len(self))

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return self._sum(self.idx, g, self.row, width)


def fit(x: Rows, k: int, width: int, slope: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
        extra: int | None = None, steps: int = 150, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Adam over all rows. ``slope(scores, extra)`` gives the loss's slope by row and score, and
    that of the extra parameters (a bias for each score unless ``extra`` says how many)."""
    there = np.zeros(width, bool)
    there[x.idx] = True
    used = np.flatnonzero(there)
    small = Rows(x.ptr, (np.cumsum(there, dtype=np.int32) - 1)[x.idx], x.val)
    w, b = np.zeros((len(used), k)), np.zeros(k if extra is None else extra)
    m1, v1, m2, v2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, steps + 1):
        g, gb = slope(small.dot(w), b)
        gw = small.back(g, len(used)) + l2 * w
        eta = rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
        for p, gp, m, v in ((w, gw, m1, v1), (b, gb, m2, v2)):
            m *= 0.9
            m += 0.1 * gp
            v *= 0.999
            v += 0.001 * gp * gp
            p -= eta * m / (np.sqrt(v) + 1e-9)
    out = np.zeros((width, k), np.float32)
    out[used] = w
    return out, b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: Rows, target: np.ndarray, width: int, weight: np.ndarray | None = None, **how):
    """Binary logistic regression on targets in [0, 1]: ``(weights, bias)``."""
    weight = np.ones(len(target)) if weight is None else weight
    total = max(weight.sum(), 1e-9)

    def slope(z, b):
        g = weight * (sigmoid(z[:, 0] + b[0]) - target) / total
        return g[:, None], np.array([g.sum()])

    w, b = fit(x, 1, width, slope, **how)
    return w[:, 0], float(b[0])


def fit_softmax(x: Rows, y: np.ndarray, k: int, width: int, **how):
    """Multinomial logistic regression on class numbers: ``(weights, biases)``."""
    hot = np.eye(k)[y]

    def slope(z, b):
        g = (softmax(z + b) - hot) / max(len(y), 1)
        return g, g.sum(axis=0)

    return fit(x, k, width, slope, **how)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_svm(x: Rows, sign: np.ndarray, width: int, **how):
    """Linear support vector machine (squared hinge, classes balanced): ``(weights, bias)``."""
    c = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1))

    def slope(z, b):
        g = -2 * c * sign * np.maximum(0, 1 - sign * (z[:, 0] + b[0]))
        return g[:, None], np.array([g.sum()])

    w, b = fit(x, 1, width, slope, **how)
    return w[:, 0], float(b[0])


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashed ids, first id of each text)`` of a shard; a text of under three bytes has none."""
    size = np.maximum(np.diff(off) - 2, 0)
    ptr = np.concatenate([[0], np.cumsum(size)])
    if not ptr[-1]:
        return np.zeros(0, np.uint32), ptr
    low = LOWER_NP[data].astype(np.uint32)
    ids = (low[:-2] | (low[1:-1] << np.uint32(8)) | (low[2:] << np.uint32(16))) * np.uint32(0x9E3779B1) >> np.uint32(32 - TRIGRAM_BITS)
    if len(size) == 1:
        return ids, ptr
    inside = np.ones(len(ids), bool)
    edge = off[1:-1]
    for back in (1, 2):
        inside[np.clip(edge - back, 0, len(ids) - 1)[(edge >= back) & (edge - back < len(ids))]] = False
    # texts under three bytes: whatever starts in them leaves as well
    short = np.flatnonzero(np.diff(off) < 3)
    for i in short:
        inside[off[i]:min(off[i + 1], len(ids))] = False
    return ids[inside], ptr


def trigram_scores(data: np.ndarray, off: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Mean weight of each text's trigrams times ``SCALE``, one column a classifier."""
    ids, ptr = trigrams(data, off)
    size = np.diff(ptr)
    out = np.zeros((len(size), w.shape[1]))
    full = np.flatnonzero(size)
    if len(full):
        for k in range(w.shape[1]):
            out[full, k] = np.add.reduceat(w[ids, k], ptr[full], dtype=np.float64) * SCALE / size[full]
    return out


def trigram_rows(col: pa.Array) -> Rows:
    """Trigram shares of whole texts as sparse rows."""
    ptrs, idx, val = [np.zeros(1, np.int64)], [], []
    for _, _, data, off in shards(col):
        ids, ptr = trigrams(data, off)
        doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        key, count = np.unique(doc << TRIGRAM_BITS | ids, return_counts=True)
        row = key >> TRIGRAM_BITS
        idx.append((key & ((1 << TRIGRAM_BITS) - 1)).astype(np.int32))
        val.append((count * SCALE / np.diff(ptr)[row]).astype(np.float32))
        ptrs.append(ptrs[-1][-1] + np.cumsum(np.bincount(row, minlength=len(ptr) - 1)))
    return Rows(np.concatenate(ptrs), np.concatenate([*idx, np.zeros(0, np.int32)]), np.concatenate([*val, np.zeros(0, np.float32)]))


def tokens(data: np.ndarray, off: np.ndarray, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` of a shard's token sets, sorted by text; ``some``: only these tokens."""
    low = LOWER_NP[data]
    s, e = word_spans(low, off)
    doc = np.searchsorted(off, s, side="right") - 1
    shift = np.uint64(64 - TOKEN_BITS)
    keys = []
    for n in (0, 4, 5, 6, 7, 8):
        at = np.flatnonzero(e - s > n) if n else slice(None)
        ids = (span_hash(low, s[at], s[at] + n if n else e) + np.uint64(n) >> shift).astype(np.int64)
        where = doc[at]
        if some is not None:
            ok = some[ids]
            ids, where = ids[ok], where[ok]
        keys.append(where << TOKEN_BITS | ids)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    text, token = key >> TOKEN_BITS, key & ((1 << TOKEN_BITS) - 1)
    words = np.bincount(doc, minlength=len(off) - 1)[text]
    texts, features = [text], [token]
    for level, ok in enumerate((count >= 2, count >= 0.005 * words, count >= 0.02 * words), 1):
        texts.append(text[ok])
        features.append(token[ok] | level << TOKEN_BITS)
    text, feature = np.concatenate(texts), np.concatenate(features)
    order = np.argsort(text, kind="stable")
    return text[order], feature[order]


def tokens_in(features: np.ndarray) -> np.ndarray:
    """Mask of the tokens that have any of the masked features."""
    return features.reshape(LEVELS, -1).any(axis=0)


def token_rows(col: pa.Array, features: np.ndarray | None = None) -> Rows:
    """Token sets of whole texts as sparse rows of ones (only the masked features, if given)."""
    ptrs, idx = [np.zeros(1, np.int64)], []
    some = None if features is None else tokens_in(features)
    for a, b, data, off in shards(col):
        text, feature = tokens(data, off, some)
        if features is not None:
            ok = features[feature]
            text, feature = text[ok], feature[ok]
        idx.append(feature.astype(np.int32))
        ptrs.append(ptrs[-1][-1] + np.cumsum(np.bincount(text, minlength=b - a)))
    i = np.concatenate([*idx, np.zeros(0, np.int32)])
    return Rows(np.concatenate(ptrs), i, np.ones(len(i), np.float32))


def token_counts(col: pa.Array, weight: np.ndarray) -> np.ndarray:
    """By feature, the weights' sum over the texts that have it (one row a weight)."""
    out = np.zeros((len(weight), TOKEN_WIDTH))
    for a, _, data, off in shards(col):
        text, feature = tokens(data, off)
        for k, w in enumerate(weight):
            out[k] += np.bincount(feature, w[a + text], TOKEN_WIDTH)
    return out


def release() -> None:
    """Give freed memory back to the system: a worker that is used again starts small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def lean(many: np.ndarray, inside: np.ndarray, n: float, n1: float) -> np.ndarray:
    """By feature, by how many standard errors its texts lean to a class of ``n1`` in ``n`` texts
    (``many``: texts that have the feature, ``inside``: those of the class)."""
    share = np.clip(n1 / max(n, 1e-9), 1e-6, 1 - 1e-6)
    return (inside - many * share) / np.sqrt(np.maximum(many * share * (1 - share), 1e-9))


def token_scores(data: np.ndarray, off: np.ndarray, w: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's features (``some``: the tokens that have any weight)."""
    text, feature = tokens(data, off, some)
    return np.bincount(text, w[feature], len(off) - 1)


def score_texts(docs: DataFrame, send, score: Callable, ddl: str, arrow: pa.DataType, name: str) -> DataFrame:
    """``docs`` with a column ``name`` made by ``score(model, column, data, offsets)`` per shard.

    ``send`` is a broadcast model. The other columns pass through; no shuffle."""
    rest = [c for c in docs.columns if c != "text"]
    src = docs.select("text", *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + f", `{name}` {ddl}"
    names = [*src.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in shards(batch.column(0)):
                part = batch.slice(a, b - a)
                made = score(send.value, part.column(0), data, off)
                made = made if isinstance(made, pa.Array) else pa.array(made)
                yield pa.RecordBatch.from_arrays([*part.columns, made.cast(arrow)], names)

    ship_package(docs.sparkSession)
    return src.mapInArrow(run, schema).select(*docs.columns, name)


def fit_in_task(sample: DataFrame, train: Callable[[pa.Table], bytes]) -> bytes | None:
    """Run ``train`` over a bounded sample in one task; its packed model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        model = train(pa.Table.from_batches(got)) if got else None
        got.clear()
        release()
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    ship_package(sample.sparkSession)
    # sorted, so that the model doesn't hang on the order in which rows arrive
    plain = [c for c, kind in sample.dtypes if c != "text" and not kind.startswith("array")]
    by = [*plain, F.xxhash64("text")] if "text" in sample.columns else plain
    row = sample.repartition(1).sortWithinPartitions(*by).mapInArrow(run, "model binary").first()
    return None if row is None else bytes(row["model"])


def bounded(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows of a narrow table, the same ones at every run."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string")), *rows.columns).limit(limit)


def sample_texts(docs: DataFrame, chosen: DataFrame, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``text`` of the chosen rows (a bounded table, so it may be broadcast) with its columns: one row
    each, so of several texts that share the columns ``on`` the one of least hash counts."""
    found = docs.select(*on, "text").join(F.broadcast(chosen), list(on))
    return found.groupBy(*chosen.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def trigram_sample(sample: DataFrame) -> DataFrame:
    """``sample`` with its texts turned to trigram shares (``ids``, ``shares``) in the tasks that hold
    them: a row has ``2**TRIGRAM_BITS`` entries at most, however long its text."""
    rest = [c for c in sample.columns if c != "text"]
    src = sample.select("text", *rest)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text") + ", ids array<int>, shares array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                x = trigram_rows(part.column(0))
                ptr = pa.array(x.ptr.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.ListArray.from_arrays(ptr, pa.array(x.idx.astype(np.int32))),
                                                  pa.ListArray.from_arrays(ptr, pa.array(x.val.astype(np.float32)))], [*rest, "ids", "shares"])
        release()

    ship_package(sample.sparkSession)
    return src.mapInArrow(run, ddl)


def trigrams_of(table: pa.Table) -> Rows:
    """The sparse rows of a table that ``trigram_sample`` made."""
    ids, shares = (table.column(c).combine_chunks() for c in ("ids", "shares"))
    return Rows(np.append(0, np.cumsum(ids.value_lengths().to_numpy())), ids.flatten().to_numpy(), shares.flatten().to_numpy())
