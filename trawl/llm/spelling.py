"""Operator 13, spelling variant grouping over permuterm rotations.

Two words are near if one inserted, deleted or replaced code point turns one into the other. A
word's terminator-marked rotations are ``word[i:] + "$" + word[:i]``. A replacement at place ``i``
leaves the rotation that starts behind it equal but for its last code point; a word with one code
point more has a rotation that, without its last code point, is a whole rotation of the shorter
one. So every word sends

* its whole rotations (kind 0), and
* its rotations without the last code point, the one skipped (kind 1),

and the rotations are sorted. Equal ones stand together: at most one word by a whole rotation
(the rotation spells it) and one word for each skipped letter, so a group never holds more rows than
the alphabet has letters, whatever the data. One scan over the sorted groups gives each member how
many near words it has there and the most frequent of them; no pairs are made. Deleting any letter of
a run of equal letters gives the same word: only the first of the run counts.

Words are numbered in code-point order first (``wid``), so shuffles carry numbers and the smallest
number settles ties. Rotations of words over ``LONG`` code points would cost the square of the
length; those words send 128-bit hashes of the same rotations, made from prefix sums.

Defined results: null and empty texts have no words; a run of letters of any length is one word;
equal rows count as occurrences each; ties of ``n`` go to the smaller word in code-point order; an
empty table (or no repeated word) gives an empty result; columns other than the named ones aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.corpus import running_totals
from ..session import cut, ship_package
from .textbytes import mix64

#: Code points of a word; A-Z are the only letters lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longer words send hashes of their rotations.
LONG = 128

_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def letter_runs(docs: DataFrame, min_length: int = 1) -> DataFrame:
    """``(doc_id, run)``: every maximal run of letters of at least ``min_length`` code points,
    lower-cased, an occurrence a row."""
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), 0)
    return docs.select("doc_id", F.explode(runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def without_code_point(word: Column, place: Column) -> Column:
    """``word`` without its code point ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word)))


def vocabulary(words: DataFrame, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """Occurrences ``word`` to ``(wid, word, n)``: the distinct words of at least ``min_length`` code
    points and ``min_count`` occurrences, numbered in code-point order."""
    counted = (words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") >= min_count))
    return cut(running_totals(counted, ["word"], []).select(F.col("row_no").alias("wid"), "word", "n"), "vocabulary")


def _spelled(words: DataFrame) -> DataFrame:
    """Rotations as strings: ``(key, wid, n, kind, lead)``."""
    size = F.char_length("word")
    at = words.select("wid", "word", "n", size.alias("size"), F.explode(F.sequence(F.lit(0), 2 * size)).alias("j"))
    kind = (F.col("j") > F.col("size")).cast("int")
    at = at.select("wid", "word", "n", "size", kind.alias("kind"), (F.col("j") - kind * (F.col("size") + 1)).alias("i"))
    letter = F.substring("word", F.col("i") + 1, F.lit(1))
    key = F.concat(F.substring("word", F.col("i") + 1 + F.col("kind"), F.col("size")), F.lit("$"),
                   F.substring("word", F.lit(1), F.col("i")))
    lead = (F.col("kind") == 1) & ((F.col("i") == 0) | (F.substring("word", F.col("i"), F.lit(1)) != letter))
    return at.select(key.alias("key"), "wid", "n", "kind", lead.alias("lead"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wid, word, n) to the same rows, keys hashed: O(1) a rotation from prefix sums."""
    for batch in batches:
        for wid, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
            size = len(c)
            i = np.concatenate([np.arange(size + 1), np.arange(size)])
            kind = np.repeat([0, 1], [size + 1, size])
            keys = []
            for base in _BASE:
                power = np.full(size + 2, base, np.uint64)
                power[0] = 1
                power = np.cumprod(power, dtype=np.uint64)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(c ^ np.uint64(base)) * power[:size])])
                inverse = np.uint64(pow(base, -1, 1 << 64))
                back = np.full(size + 2, inverse, np.uint64)
                back[0] = 1
                back = np.cumprod(back, dtype=np.uint64)
                start = i + kind  # the rotation: word[start:], the terminator, word[:i]
                tail = size - start
                rest = (sums[size] - sums[start]) * back[start]
                keys.append(mix64(rest + power[tail] + sums[i] * power[tail + 1]).view(np.int64))
            first = np.concatenate([np.ones(1, bool), c[1:] != c[:-1]])
            lead = np.concatenate([np.zeros(size + 1, bool), first])
            m = len(i)
            for a in range(0, m, 1 << 16):
                s = slice(a, min(a + (1 << 16), m))
                text = [f"#{size + 1 + t}:{x:016x}{y:016x}" for t, x, y in
                        zip((-kind[s]).tolist(), keys[0][s].view(np.uint64).tolist(), keys[1][s].view(np.uint64).tolist())]
                k = len(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text), pa.array(np.full(k, wid, np.int64)), pa.array(np.full(k, n, np.int64)),
                     pa.array(kind[s].astype(np.int32)), pa.array(lead[s])], ["key", "wid", "n", "kind", "lead"])


def rotations(vocab: DataFrame) -> DataFrame:
    """``(key, wid, n, kind, lead)``: a row for every whole rotation (kind 0) and every rotation
    without its last code point (kind 1; ``lead``: it is the first of a run of equal letters)."""
    ship_package(vocab.sparkSession)
    size = F.char_length("word")
    return _spelled(vocab.where(size <= LONG)).unionByName(
        vocab.where(size > LONG).select("wid", "word", "n")
        .mapInArrow(_hashed, "key string, wid long, n long, kind int, lead boolean"))


def near_words(vocab: DataFrame) -> DataFrame:
    """``(wid, n_near, best)`` for words that have near words; ``best`` is ``(n, place)`` of the most
    frequent of them, ``place`` = minus its ``wid``."""
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.col("kind").desc(), F.col("n").desc(), "wid")
    word = F.struct("n", (-F.col("wid")).alias("place"))
    skips = F.count(F.when(F.col("kind") == 1, 1)).over(group)
    rows = rotations(vocab).select(
        "wid", "kind", "lead", skips.alias("skips"),
        F.count(F.when(F.col("lead"), 1)).over(group).alias("leads"),
        F.max(F.when(F.col("kind") == 0, word)).over(group).alias("whole"),
        F.max(F.when(F.col("lead"), word)).over(group).alias("longer"),
        F.max(F.when(F.col("kind") == 1, word)).over(group).alias("first"),
        F.lead(word).over(ranked).alias("after"), F.row_number().over(ranked).alias("place"))
    # a member's near words here: the other skipped ones, and the whole one if it is a letter shorter
    other = F.when(F.col("skips") > 1, F.when(F.col("place") == 1, F.col("after")).otherwise(F.col("first")))
    shorter = F.when(F.col("lead"), F.col("whole"))
    best = F.when(F.col("kind") == 0, F.col("longer")).otherwise(F.greatest(other, shorter))
    near = F.when(F.col("kind") == 0, F.col("leads")).otherwise(F.col("skips") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
    return (rows.select("wid", near.alias("near"), best.alias("best")).where("near > 0")
            .groupBy("wid").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")))


def roots(links: DataFrame) -> DataFrame:
    """``(wid, to)`` links that end somewhere to ``(wid, root)``: each round follows twice as many."""
    now = cut(links.select("wid", F.col("to").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        step = cut(now.join(ahead, "root", "left").select("wid", F.coalesce("further", "root").alias("root"),
                                                          F.col("further").isNotNull().alias("moved")), "forms")
        now = step.select("wid", "root")
        if step.where("moved").isEmpty():
            return now


def group_variants(words: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """Occurrences ``word`` to ``(word, n, n_near, form, form_n, root)``, a row a word: ``form`` is its
    most frequent near word if that is at least ``ratio`` times as frequent, ``root`` the last word
    that forms lead to (the word itself without one)."""
    vocab = vocabulary(words, min_length, min_count)
    near = near_words(vocab)
    known = cut(vocab.join(near, "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.place")).alias("to")), "near")
    links = known.where("to is not null").select("wid", "to")
    named = (links.join(roots(links), "wid")
             .join(vocab.select(F.col("wid").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n")), "to")
             .join(vocab.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root")
             .select("wid", "form", "form_n", "root_word"))
    return known.join(named, "wid", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))


#: CRC-32 in SQL: the table from its polynomial, then a step a byte.
CRC_SQL = """
  crc_table as (select list(v order by i) as t from (
    select i, list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i::bigint) as v from range(256) r(i)))
"""


def crc_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a string's UTF-8 bytes (with ``CRC_SQL`` and its ``t``)."""
    hexed = f"hex(encode({text}))"
    byte = f"list_transform(range(0, length({hexed}) // 2), lambda b: ('0x' || substr({hexed}, (2 * b + 1)::int, 2))::bigint)"
    return f"xor(list_reduce({byte}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


ORACLE = f"""
with recursive {CRC_SQL},
runs as (select doc_id, run, count(*) as k from (
    select doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{7,}}')), '{UPPER}', '{LOWER}') as run from documents)
  group by all),
hashed as (select run, k, {crc_sql("coalesce(doc_id::varchar, '') || ':' || run")} as h from runs, crc_table),
vocab as (select word, sum(k)::bigint as n from (
    select k, case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word
    from hashed) where length(word) >= 7 group by word having sum(k) >= 2),
cuts as (select word, i, substr(word, 1, i::int) || substr(word, i::int + 2) as rest from (select word, unnest(range(length(word))) as i from vocab)),
near as (
  select a.word, b.word as other from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select c.word, v.word from cuts c join vocab v on c.rest = v.word
  union select v.word, c.word from cuts c join vocab v on c.rest = v.word),
best as (select near.word, count(*) as n_near, min((-v.n, v.word)) as top from near join vocab v on near.other = v.word group by near.word),
formed as (select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when -b.top[1] >= 10 * v.n then b.top[2] end as form,
    case when -b.top[1] >= 10 * v.n then -b.top[1] end as form_n from vocab v left join best b on v.word = b.word),
chain as (select word, form as at from formed where form is not null
  union all select c.word, f.form from chain c join formed f on c.at = f.word where f.form is not null),
last as (select c.word, c.at from chain c join formed f on c.at = f.word where f.form is null)
select f.word, f.form, coalesce(l.at, f.word) as root, f.n, f.n_near, f.form_n from formed f left join last l on f.word = l.word
"""
