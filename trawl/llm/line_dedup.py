"""Operator 6, line dedup over a deletion neighbourhood.

Lines are the pieces between newlines; their words are separated by white space, A-Z lowered. A
line goes if an earlier line (by ``doc_id``, then place) is equal to it in words, or, if the longer
of the two has at least ``FUZZY_WORDS`` words, within one word edit (a word changed, added or left
out). The earlier line counts whether or not it stays itself.

Near lines: every line emits its variants with at most one word deleted, as 128-bit hashes; equal
variants meet. Two lines of one variant are verified by lengths and places: same length and same
place deleted (one word changed), or one whole and the other a word longer. Whoever isn't the
earliest there goes. Only minima are made per variant, never pairs.

Before that, lines that can't have a near line leave: a pair at one edit shares its first or its
last words, up to half of the longer line. Each line sends four such half keys; only lines with a
key in common with another line emit variants, and only those in the half that may differ. Texts
are shuffled once to fetch these lines and once to take lines out, as zstandard frames.

Defined results: a null text has no lines and stays null; lines without words always stay; equal
lines within a text count as well; rows equal in ``doc_id`` and text share their fate (they keep
the same lines); a null ``doc_id`` comes last; an empty table gives an empty result; the
documents' own columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textbytes import LOWER_NP, fresh, mix64, shards, span_hash, unzip, with_uid, word_spans, zip_text

#: Pairs whose longer line has fewer words are only compared for equality.
FUZZY_WORDS = 6
#: Not white space.
INK = np.ones(256, bool)
INK[[0x20, *range(0x09, 0x0E)]] = False

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_INV = np.array([pow(int(c), -1, 1 << 64) for c in _MUL], np.uint64)


def _powers(c: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = c
    return np.cumprod(out, dtype=np.uint64)


class Lines:
    """The lines with words of a shard, and hashes of any of their word ranges."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = LOWER_NP[data]
        s, e = word_spans(low, off, INK)
        nl = np.flatnonzero(low == 10)
        start = np.concatenate([off[:-1], nl + 1])
        doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, nl, side="right") - 1])
        order = np.lexsort([doc, start])
        # a newline at a text's end opens a line at the next text's start: texts come in order
        order = order[np.argsort(doc[order], kind="stable")]
        start, doc = start[order], doc[order]
        first = np.searchsorted(doc, np.arange(len(off) - 1))
        word_doc = np.searchsorted(off, s, side="right") - 1
        nls_before = np.searchsorted(nl, s) - np.searchsorted(nl, off[word_doc])
        line = first[word_doc] + nls_before
        has = np.unique(line)
        self.doc, self.ln = doc[has], has - first[doc[has]]
        at = np.searchsorted(has, line)
        self.n = np.bincount(at, minlength=len(has))
        self.head = np.cumsum(self.n) - self.n
        word = span_hash(low, s, e)
        i = np.arange(len(word)) - self.head[at]
        most = int(self.n.max()) if len(has) else 0
        self.pow = [_powers(c, most) for c in _MUL]
        self.inv = [_powers(c, most) for c in _INV]
        self.sums = []
        for k, w in enumerate((word, mix64(word ^ _MUL[0]))):
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * self.pow[k][i])]))

    def part(self, k: int, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash k of the words a..b-1 of lines, as if they began a line."""
        h = self.head[rows]
        return (self.sums[k][h + b] - self.sums[k][h + a]) * self.inv[k][a]

    def without(self, k: int, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Hash k of lines without their word p."""
        n = self.n[rows]
        return self.part(k, rows, np.zeros_like(p), p) + self.part(k, rows, p + 1, n) * self.pow[k][p]

    def whole(self, k: int) -> np.ndarray:
        rows = np.arange(len(self.n))
        return mix64(self.part(k, rows, np.zeros_like(self.n), self.n) ^ (self.n.astype(np.uint64) * _MUL[1]))

    def half_keys(self) -> list[np.ndarray]:
        """Keys of the first and the last words, for a longer line of n and of n + 1 words."""
        rows, zero = np.arange(len(self.n)), np.zeros_like(self.n)
        out = []
        for kind in range(4):
            longer = self.n + kind // 2
            m = (longer - 1) // 2
            a, b = (zero, m) if kind % 2 == 0 else (self.n - m, self.n)
            out.append(mix64(self.part(0, rows, a, b) ^ ((longer * 2 + kind % 2).astype(np.uint64) * _MUL[1])))
        return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, doc_id, text) to a row for every line with words: place, 128-bit hash, half keys."""
    for batch in batches:
        for a, b, data, off in shards(batch.column(2)):
            x = Lines(data, off)
            at = pa.array(x.doc + a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(x.ln.astype(np.int32)), pa.array(x.n.astype(np.int32)),
                 *(_long(x.whole(k)) for k in (0, 1)), *(_long(k) for k in x.half_keys())],
                ["uid", "doc_id", "ln", "n", "h1", "h2", "k0", "k1", "k2", "k3"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, to those whose key another row has as well (streamed)."""
    last, seen = None, False  # the last row so far, and whether it was passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        same = key[1:] == key[:-1]
        joined = last is not None and last.column(0)[0].as_py() == key[0]
        out = np.zeros(len(key), bool)
        out[1:] |= same
        out[:-1] |= same
        out[0] |= joined
        if joined and not seen:
            yield last.select(["uid", "ln", "kind"])
        hit = batch.filter(pa.array(out)).select(["uid", "ln", "kind"])
        if hit.num_rows:
            yield hit
        last, seen = batch.slice(len(key) - 1), bool(out[-1])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, doc_id, zipped text, lns, kinds) to the flagged lines' variants."""
    for batch in batches:
        for a, b, data, off in shards(pa.array(unzip(batch.column(2)), pa.large_binary())):
            x = Lines(data, off)
            lns, kinds = batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a)
            many = np.array([len(v) for v in lns.to_pylist()], np.int64)
            doc = np.repeat(np.arange(b - a), many)
            place = doc * (1 << 32) + lns.flatten().to_numpy()
            mask = kinds.flatten().to_numpy()
            have = x.doc * (1 << 32) + x.ln
            rows = np.searchsorted(have, place)
            n = x.n[rows]
            m = (n - 1) // 2
            # places whose deletion may meet another line of n (or n - 1) words
            lo = np.where(mask & 2, 0, m)
            hi = np.where(mask & 1, n, n - m)
            size = np.where(mask & 3, hi - lo, 0)
            each = np.repeat(np.arange(len(rows)), size)
            p = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
            whole = np.flatnonzero(mask & 12)
            owner = np.concatenate([each, whole])
            length = (n[owner] - np.concatenate([np.ones(len(each), np.int64), np.zeros(len(whole), np.int64)])).astype(np.uint64)
            cut_at = np.concatenate([p, np.full(len(whole), -1)])
            vs = []
            for k in (0, 1):
                part = np.concatenate([x.without(k, rows[each], p), x.part(k, rows[whole], np.zeros_like(n[whole]), n[whole])])
                vs.append(_long(mix64(part ^ (length * _MUL[1]))))
            at = pa.array(x.doc[rows[owner]] + a)
            yield pa.RecordBatch.from_arrays(
                [*vs, pa.array(cut_at.astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(x.ln[rows[owner]].astype(np.int32))], ["v1", "v2", "p", "uid", "doc_id", "ln"])


def _strip(names: list[str]):
    """(zipped text, removed lns, rest...) to (text without these lines, lines, removed, rest...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = unzip(batch.column(0)), batch.column(1).to_pylist()
            out, lines, removed, empty = [], [], [], []
            for t, g in zip(texts, gone):
                pieces = [] if t is None else t.split(b"\n")
                drop = set(g or ())
                kept = [v for i, v in enumerate(pieces) if i not in drop]
                out.append(None if t is None else b"\n".join(kept))
                lines.append(len(pieces))
                removed.append(len(pieces) - len(kept))
                empty.append(bool(drop) and not out[-1].strip())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(empty, pa.bool_()),
                 *batch.columns[2:]], names)

    return run


def _place(prefix: str = "") -> F.Column:
    return F.struct(F.col(f"{prefix}doc_id").isNull().alias("no"), F.col(f"{prefix}doc_id").alias("doc_id"),
                    F.col(f"{prefix}ln").alias("ln"), F.col(f"{prefix}uid").alias("uid"))


def removed_lines(docs: DataFrame, uid: str, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """``(uid, gone)``: the numbers of the lines that go, for each key with any."""
    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select(F.col(uid).alias("uid"), "doc_id", "text")
    lines = cut(src.mapInArrow(_line_rows, f"uid long, doc_id {kind}, ln int, n int, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long"),
                "lines")
    groups = cut(lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("c"), F.first("n").alias("n"),
                                               *(F.first(k).alias(k) for k in ("k0", "k1", "k2", "k3"))), "line_groups")
    again = groups.where("c > 1").select("h1", "h2", "first")
    exact = lines.join(again, ["h1", "h2"]).where(_place() > F.col("first")).select("uid", "ln")
    # near lines, among first occurrences
    keys = (groups.where(F.col("n") >= fuzzy_words - 1)
            .select("first.uid", "first.ln", "n", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("kind", "key"))
            # a line one word under the bound can only be the shorter one
            .where((F.col("n") >= fuzzy_words) | (F.col("kind") > 1)).select("key", "uid", "ln", "kind"))
    flagged = (keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "uid long, ln int, kind int")
               .groupBy("uid", "ln").agg(F.expr("bit_or(shiftleft(1, kind))").alias("kinds"))
               .groupBy("uid").agg(F.collect_list(F.struct("ln", "kinds")).alias("l"))
               .select("uid", F.col("l.ln").alias("lns"), F.col("l.kinds").alias("kinds")))
    zipped = src.select("uid", "doc_id", zip_text("text").alias("text"))
    found = (zipped.join(flagged, "uid").select("uid", "doc_id", "text", "lns", "kinds")
             .mapInArrow(_variants, f"v1 long, v2 long, p int, uid long, doc_id {kind}, ln int"))
    found = cut(found.select("v1", "v2", "p", _place().alias("at")), "line_variants")
    by_place = found.groupBy("v1", "v2", "p").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    by_variant = by_place.groupBy("v1", "v2").agg(F.min(F.when(F.col("p") < 0, F.col("low"))).alias("whole"),
                                                  F.min(F.when(F.col("p") >= 0, F.col("low"))).alias("longer"))
    met = by_place.where("low < high").select("v1", "v2", "p", "low")
    changed = found.where("p >= 0").join(met, ["v1", "v2", "p"]).where("at > low").select("at")
    both = by_variant.where("whole is not null and longer is not null")
    added = (found.join(both, ["v1", "v2"])
             .where((F.col("p") < 0) & (F.col("at") > F.col("longer")) | (F.col("p") >= 0) & (F.col("at") > F.col("whole"))).select("at"))
    near = changed.union(added).select("at.uid", "at.ln")
    return exact.union(near).groupBy("uid").agg(F.collect_set("ln").alias("gone"))


def dedup_lines(docs: DataFrame, fuzzy_words: int = FUZZY_WORDS, name: str = "lines") -> DataFrame:
    """``docs`` with the lines taken out of ``text``, and a struct (``n_lines``, ``n_removed``,
    ``emptied``: nothing but white space is left after lines went)."""
    uid, name = fresh(docs, "_uid"), fresh(docs, name)
    tagged = with_uid(docs, uid)
    gone = removed_lines(tagged, uid, fuzzy_words)
    gone = gone.select(F.col("uid").alias(uid), F.col("gone").alias(name))
    rest = [c for c in docs.columns if c != "text"]
    src = tagged.select(uid, zip_text("text").alias("text"), *rest).join(gone, uid, "left").select("text", name, *rest)
    parts = [fresh(docs, f"_{k}") for k in ("lines", "removed", "emptied")]
    names = ["text", *parts, *rest]
    kinds = dict(docs.dtypes)
    ddl = ", ".join([f"text string, `{parts[0]}` long, `{parts[1]}` long, `{parts[2]}` boolean", *(f"`{c}` {kinds[c]}" for c in rest)])
    out = src.mapInArrow(_strip(names), ddl)
    return out.select(*docs.columns, F.struct(F.col(parts[0]).alias("n_lines"), F.col(parts[1]).alias("n_removed"), F.col(parts[2]).alias("emptied")).alias(name))


def drop_repeated_lines(docs: DataFrame, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """The documents without their repeated lines; those that nothing is left of go. Columns as in
    ``docs`` (``n_chars``, if there is one, follows the text)."""
    name = fresh(docs, "lines")
    out = dedup_lines(docs, fuzzy_words, name).where(~F.col(f"{name}.emptied")).select(*docs.columns)
    if "n_chars" in docs.columns:
        n = F.coalesce(F.char_length("text"), F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", n)
    return out


ORACLE = r"""
with l as (
  select doc_id, ln, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') w
  from (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 ln
        from documents where text is not null)),
j as (select doc_id, ln, w, array_to_string(w, ' ') k, (doc_id, ln) pl from l where len(w) > 0),
f as (select k, any_value(w) w, min(pl) pl from j group by k),
exact as (select doc_id, ln from j join f using (k) where j.pl > f.pl),
v as (
  select pl, p, array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ') v
  from (select pl, w, unnest(range(1, len(w) + 1)) p from f where len(w) >= 6)
  union all select pl, 0, k from f where len(w) >= 5),
lo as (select v, p, min(pl) low from v group by v, p),
near as (
  select pl from v join lo using (v, p) where p > 0 and pl > low
  union all select a.pl from v a join lo b using (v) where (a.p = 0) <> (b.p = 0) and a.pl > b.low),
gone as (select distinct doc_id, ln from (
  select doc_id, ln from exact union all select pl[1] doc_id, pl[2] ln from near)),
kept as (
  select doc_id, string_agg(t, chr(10) order by ln) text, count(*) n
  from (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 ln
        from documents where text is not null) anti join gone using (doc_id, ln) group by doc_id)
select d.doc_id, cast(coalesce(len(string_split(d.text, chr(10))), 0) as bigint) n_lines,
       cast(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(n, 0) as bigint) n_removed,
       sha256(coalesce(kept.text, '')) kept_sha256
from documents d left join kept using (doc_id)
"""
