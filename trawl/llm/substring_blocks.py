r"""Operator 12, substring dedup over fixed-block anchors.

Words are runs of anything but white space. A window is ``WINDOW`` consecutive words of a text; a
word goes if it lies in a window whose words also start in a document with a smaller ``doc_id``.

1. Pieces. Every window has a smallest hashed ``GRAM``-word run; neighbouring windows with the same
   one form a piece. Equal windows lie in pieces with an equal smallest run, so pieces whose run no
   other document holds can't lose a word. Equal pieces fold: all but those of the smallest document go
   whole. What is left to compare are pieces with an equal run and different words around it, each once.
2. Fixed blocks. The words of those pieces are cut into non-overlapping reference blocks of ``BLOCK``
   words (by their place in the document) and probed with every rolling window of ``BLOCK`` words. Any
   window holds ``SPAN`` whole blocks of whichever document it stands in, one after another; of
   such ``SPAN`` only the smallest hash is sent, on both sides by the same rule, which loses nothing.
   Hits are probes of a block of a smaller document.
3. Extension. Around every hit and every block hit, each window is sent by a 128-bit hash of its words
   to find the smallest document that holds it; neighbouring windows that a smaller document holds
   make up the maximal exact repeat.

All steps are joins and grouped minima on hashes: a passage that a third of all documents hold is one
row a task before each shuffle of a minimum, and joins on it can be split. No pairs are made. Texts cross
the shuffle twice, as zstandard frames: once to those with pieces to compare, once to take words out.

Defined results: a null text has no words and keeps an empty text; texts shorter than a window stay;
texts of any length are taken whole (passes work on shards of 1 MB or one text); a null ``doc_id`` is
neither smaller nor greater: it loses nothing and takes nothing; rows with one ``doc_id`` don't
affect each other; repeats within a document stay; an empty table gives an empty result; other columns
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship_package
from .textbytes import fresh, mix64, shards, span_hash, unzip, word_spans, zip_text

WINDOW = 50
GRAM = 12
BLOCK = 10
#: Whole blocks, one after another, that every window holds wherever it starts.
SPAN = (WINDOW - BLOCK + 1) // BLOCK

#: Not white space.
INK = np.ones(256, bool)
INK[[0x20, *range(0x09, 0x0E)]] = False

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Sums:
    """Hashes of any range of a sequence of word hashes, from prefix sums."""

    def __init__(self, words: np.ndarray, base: int = _BASES[0]):
        n = len(words)
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        self.back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        power, self.back = np.cumprod(power, dtype=np.uint64), np.cumprod(self.back, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words ^ np.uint64(base)) * power[:n])])

    def of(self, a, b) -> np.ndarray:
        """Hash of the words a..b-1."""
        return mix64((self.sums[b] - self.sums[a]) * self.back[a] ^ np.asarray(b - a, np.uint64))


def rolling(sums: Sums, n: int, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    a = np.arange(max(0, n - size + 1))
    return sums.of(a, a + size)


def smallest(values: np.ndarray, width: int, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of every ``width`` values ``stride`` apart: the smallest, and the place of the first such."""
    best, at = values, np.arange(len(values))
    reach = 1
    while reach < width:
        step = min(reach, width - reach) * stride
        right = best[step:] < best[:len(best) - step]
        at = np.where(right, at[step:], at[:len(best) - step])
        best = np.where(right, best[step:], best[:len(best) - step])
        reach += min(reach, width - reach)
    return best, at


def text_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text)`` of every word of a shard."""
    s, e = word_spans(data, off, INK)
    return span_hash(data, s, e), np.searchsorted(off, s, side="right") - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to pieces: smallest run, hash of the piece's words, first window, windows."""
    for batch in batches:
        for a, b, data, off in shards(batch.column(1)):
            words, text = text_hashes(data, off)
            n = len(words)
            if n < WINDOW:
                continue
            sums = Sums(words)
            run, at = smallest(rolling(sums, n, GRAM), WINDOW - GRAM + 1)
            x = np.flatnonzero(text[:n - WINDOW + 1] == text[WINDOW - 1:])
            if not len(x):
                continue
            new = np.ones(len(x), bool)
            new[1:] = (at[x[1:]] != at[x[:-1]]) | (x[1:] != x[:-1] + 1)
            first, last = x[new], x[np.append(np.flatnonzero(new)[1:], len(x)) - 1]
            head = np.searchsorted(text, np.arange(b - a))
            yield pa.RecordBatch.from_arrays(
                [_signed(run[first]), _signed(sums.of(first, last + WINDOW)), batch.column(0).take(pa.array(text[first] + a)),
                 pa.array((first - head[text[first]]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
                ["run", "piece", "doc_id", "start", "windows"])


def _owned(texts: pa.Array, lists: pa.Array):
    """Shards of texts with their listed places: ``(first row, rows, word hashes, word heads, row of
    each place, places' structs as columns)``."""
    at = lists.offsets.to_numpy()
    fields = lists.values
    for a, b, data, off in shards(texts):
        words, text = text_hashes(data, off)
        heads = np.searchsorted(text, np.arange(b - a + 1))
        row = np.repeat(np.arange(b - a), np.diff(at[a:b + 1]))
        yield a, b, words, heads, row, fields.slice(at[a], at[b] - at[a])


def _fits(sums: Sums, heads, row, start, windows, piece):
    """Whether a row's own words at a listed place are the piece's (rows may share a doc_id)."""
    size = heads[row + 1] - heads[row]
    inside = start + windows + WINDOW - 1 <= size
    a = heads[row] + np.where(inside, start, 0)
    b = np.where(inside, a + windows + WINDOW - 1, a)
    return inside & (sums.of(a, b) == piece.view(np.uint64))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text key, zipped text, pieces to compare) to the word ranges they cover, as hashes."""
    for batch in batches:
        texts = pa.array(unzip(batch.column("text")), pa.large_binary())
        for a, _, words, heads, row, place in _owned(texts, batch.column("places")):
            start, windows, piece = (place.field(c).to_numpy().astype(np.int64) for c in ("start", "windows", "piece"))
            ok = _fits(Sums(words), heads, row, start, windows, piece)
            row, start, end = row[ok], start[ok], start[ok] + windows[ok] + WINDOW - 1
            order = np.lexsort([start, row])
            row, start, end = row[order], start[order], end[order]
            # pieces follow each other without a gap between their windows, or are another range
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1] - WINDOW + 1)
            lo = np.flatnonzero(new)
            if not len(lo):
                continue
            s, e, r = start[lo], np.maximum.reduceat(end, lo), row[lo]
            size = e - s
            flat = np.repeat(heads[r] + s - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            whose = pa.array(r + a)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(whose), batch.column("text_key").take(whose), pa.array(s.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), _signed(words[flat]))],
                ["doc_id", "text_key", "start", "words"])


def _range_columns(batch: pa.RecordBatch):
    """Word hashes of a batch of ranges one after another, their heads, range and place of each word."""
    lists = batch.column("words")
    heads = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.to_numpy()[heads[0]:heads[-1]].view(np.uint64)
    heads = heads - heads[0]
    row = np.repeat(np.arange(batch.num_rows), np.diff(heads))
    place = np.arange(len(words)) - heads[row] + batch.column("start").to_numpy()[row]
    return words, heads, row, place


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Some hundred thousand words at a time (or one range)."""
    at = batch.column("words").offsets.to_numpy().astype(np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + (1 << 18), side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges to blocks and probes: rolling runs of ``BLOCK`` words that are the smallest of ``SPAN``
    of them ``BLOCK`` words apart; ``block``: the run is a reference block."""
    for whole in batches:
        for batch in _slices(whole):
            words, _, row, place = _range_columns(batch)
            hashes = rolling(Sums(words), len(words), BLOCK)
            least, _ = smallest(hashes, SPAN, BLOCK)
            inside = row[:len(least)] == row[SPAN * BLOCK - 1:][:len(least)]
            sent = np.zeros(len(hashes), bool)
            for j in range(SPAN):
                mine = hashes[j * BLOCK:][:len(least)] == least
                sent[np.flatnonzero(mine & inside) + j * BLOCK] = True
            p = np.flatnonzero(sent)
            yield pa.RecordBatch.from_arrays(
                [_signed(hashes[p]), batch.column("doc_id").take(pa.array(row[p])), pa.array(place[p].astype(np.int32)),
                 pa.array(place[p] % BLOCK == 0)], ["hash", "doc_id", "place", "block"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges with the places of hits to the windows that hold one, by 128-bit hash."""
    for whole in batches:
        for batch in _slices(whole):
            words, heads, row, place = _range_columns(batch)
            lists = batch.column("hits")
            many = np.diff(lists.offsets.to_numpy())
            r = np.repeat(np.arange(batch.num_rows), many)
            at = lists.flatten().to_numpy().astype(np.int64) - batch.column("start").to_numpy()[r]
            ok = (at >= 0) & (at + BLOCK <= np.diff(heads)[r])
            edge = np.zeros(len(words) + 1, np.int64)
            lo = np.maximum(heads[r[ok]], heads[r[ok]] + at[ok] + BLOCK - WINDOW)
            np.add.at(edge, lo, 1)
            np.add.at(edge, heads[r[ok]] + at[ok] + 1, -1)
            n = max(0, len(words) - WINDOW + 1)
            x = np.flatnonzero((np.cumsum(edge)[:n] > 0) & (row[:n] == row[WINDOW - 1:][:n]))
            both = [Sums(words, base).of(x, x + WINDOW) for base in _BASES]
            whose = pa.array(row[x])
            yield pa.RecordBatch.from_arrays(
                [*map(_signed, both), batch.column("doc_id").take(whose), batch.column("text_key").take(whose),
                 pa.array(place[x].astype(np.int32))], ["w1", "w2", "doc_id", "text_key", "start"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(doc_id, places)``: windows that go, as structs: first window, windows, and either the hash
    of the piece (``piece``) or the key of the text (``text_key``) that they hold for."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    known = docs.where(F.col("doc_id").isNotNull())
    pieces = known.select("doc_id", "text").mapInArrow(_pieces, f"run long, piece long, doc_id {kind}, start int, windows int")
    # sides of joins that were grouped by the same key are written first: the join can then be split
    shared = cut(pieces.groupBy("run").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("run"), "runs")
    found = cut(pieces.join(shared, "run"), "pieces")
    heads = found.groupBy("run", "piece").agg(F.min("doc_id").alias("head"))
    heads = cut(heads, "piece-heads")
    mixed = cut(heads.groupBy("run").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("run", F.lit(True).alias("mixed")), "mixed")
    marked = found.join(heads, ["run", "piece"]).join(mixed, "run", "left").select(
        "doc_id", "start", "windows", "piece", (F.col("doc_id") > F.col("head")).alias("folds"), "mixed")
    marked = cut(marked.where("folds or mixed"), "pieces-marked")

    wanted = marked.where("not folds").groupBy("doc_id").agg(F.collect_set(F.struct("start", "windows", "piece")).alias("places"))
    texts = known.select("doc_id", F.xxhash64("text").alias("text_key"), zip_text("text").alias("text"))
    ranges = cut(texts.join(wanted, "doc_id").select("doc_id", "text_key", "text", "places")
                 .mapInArrow(_ranges, f"doc_id {kind}, text_key long, start int, words array<long>"), "ranges")
    anchors = cut(ranges.mapInArrow(_anchors, f"hash long, doc_id {kind}, place int, block boolean"), "anchors")
    blocks = anchors.where("block")
    index = cut(blocks.groupBy("hash").agg(F.min("doc_id").alias("lowest")), "blocks")
    probed = cut(anchors.join(index, "hash").where("doc_id > lowest").select("hash", "doc_id", "place"), "block-hits")
    # the blocks that were hit, and the probes that hit them
    ends = blocks.join(cut(probed.select("hash").distinct(), "blocks-hit"), "hash").select("doc_id", "place").union(probed.select("doc_id", "place"))
    hits = ends.groupBy("doc_id").agg(F.collect_set("place").alias("hits"))
    windows = cut(ranges.join(hits, "doc_id").select("doc_id", "text_key", "start", "words", "hits")
                  .mapInArrow(_windows, f"w1 long, w2 long, doc_id {kind}, text_key long, start int"), "windows")
    again = cut(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
                .select("w1", "w2", "low"), "windows-again")
    later = windows.join(again, ["w1", "w2"]).where("doc_id > low")
    none = F.lit(None).cast("long")
    gone = (marked.where("folds").select("doc_id", F.struct("start", "windows", "piece", none.alias("text_key")).alias("at"))
            .unionByName(later.select("doc_id", F.struct("start", F.lit(1).alias("windows"), none.alias("piece"), "text_key").alias("at"))))
    return gone.groupBy("doc_id").agg(F.collect_set("at").alias("places"))


def _take_out(names: list[str]):
    """(zipped text, text key, places, rest...) to (rest..., words, spans, kept text)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = unzip(batch.column(0))
            lists = batch.column(2)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            total, spans, kept = [], [], []
            for a, b, words, heads, row, place in _owned(pa.array(raw, pa.large_binary()), lists):
                start, windows = (place.field(c).to_numpy().astype(np.int64) for c in ("start", "windows"))
                piece = place.field("piece").fill_null(0).to_numpy().astype(np.int64)
                whole = place.field("piece").is_valid().to_numpy(zero_copy_only=False)
                mine = place.field("text_key").fill_null(0).to_numpy() == key[row + a]
                ok = np.where(whole, _fits(Sums(words), heads, row, start, windows, piece), mine)
                row, start, end = row[ok], start[ok], start[ok] + windows[ok] + WINDOW - 1
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, heads[row] + start, 1)
                np.add.at(edge, heads[row] + end, -1)
                stays = np.cumsum(edge)[:len(words)] == 0
                for i in range(a, b):
                    x, y = heads[i - a], heads[i - a + 1]
                    own, parts = stays[x:y], (raw[i] or b"").split()
                    turn = np.flatnonzero(np.diff(np.concatenate([[1], own.astype(np.int8), [1]])))
                    total.append(int(y - x))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2])])
                    kept.append(b" ".join(w for w, k in zip(parts, own.tolist()) if k))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3:], pa.array(total, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], names)

    return run


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, name: str = "repeats") -> DataFrame:
    """The columns ``keep`` (all by default) with a struct: ``n_words``, ``spans`` (maximal removed word
    ranges), ``kept`` (the other words, one space between them)."""
    keep = docs.columns if keep is None else keep
    name = fresh(docs, name)
    rest = [c for c in keep if c != "text"]
    ids, key, frame = fresh(docs, "_doc_id"), fresh(docs, "_text_key"), fresh(docs, "_text")
    gone = repeated_windows(docs.select("doc_id", "text")).select(F.col("doc_id").alias(ids), F.col("places").alias(name))
    src = (docs.select(*rest, F.col("doc_id").alias(ids), F.xxhash64("text").alias(key), zip_text("text").alias(frame),
                       *([F.col("text").alias(fresh(docs, "_plain"))] if "text" in keep else []))
           .join(gone, ids, "left").drop(ids))
    empty = F.array().cast(dict(gone.dtypes)[name])
    plain = [fresh(docs, "_plain")] if "text" in keep else []
    src = src.select(frame, key, F.coalesce(name, empty).alias(name), *rest, *plain)
    parts = [fresh(docs, f"_{c}") for c in ("n_words", "spans", "kept")]
    kinds = dict(docs.dtypes)
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *(f"`{c}` string" for c in plain), f"`{parts[0]}` long",
                     f"`{parts[1]}` array<struct<start: int, end: int>>", f"`{parts[2]}` string"])
    out = src.mapInArrow(_take_out([*rest, *plain, *parts]), ddl)
    columns = [F.col(plain[0]).alias("text") if c == "text" else F.col(c) for c in keep]
    return out.select(*columns, F.struct(*(F.col(p).alias(c) for p, c in zip(parts, ("n_words", "spans", "kept")))).alias(name))


def words_in(spans: str) -> F.Column:
    """Words in removed ranges."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
low as (select k, min(doc_id) as low from win group by k),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join low using (k) where doc_id > low),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n from each anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id)
"""
