"""Spelling variants against every pair of words."""

import random

import pytest
from pyspark.sql import functions as F

from trawl.llm import spelling as S
from trawl.llm.queries import op13_permuterm


def near(a, b):
    """Whether exactly one inserted, deleted or replaced code point lies between two words."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio):
    out = {}
    for w, n in counts.items():
        others = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(others, default=None)
        ok = best is not None and -best[0] >= ratio * n
        out[w] = (n, len(others), best[1] if ok else None, -best[0] if ok else None)
    roots = {}
    for w in out:
        at = w
        while out[at][2] is not None:
            at = out[at][2]
        roots[w] = at
    return {w: (*v, roots[w]) for w, v in out.items()}


def result(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("long", [S.LONG, 3])
def test_equals_every_pair(spark, monkeypatch, long):
    """By strings, and (``LONG`` = 3) by hashed rotations."""
    monkeypatch.setattr(S, "LONG", long)
    rng = random.Random(5)
    words = []
    for _ in range(25):
        base = "".join(rng.choice("abé") for _ in range(rng.randint(4, 7)))
        words += [base] * rng.choice([1, 2, 2, 30, 400])
        for _ in range(3):
            i, c = rng.randrange(len(base)), rng.choice("abé")
            words += [rng.choice([base[:i] + base[i + 1:], base[:i] + c + base[i:], base[:i] + c + base[i + 1:]])] * rng.choice([1, 2, 3, 20])
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 4 and n >= 2}
    want = brute(counts, 5)
    assert any(v[2] for v in want.values()) and any(v[4] != (v[2] or w) for w, v in want.items())  # chains too
    got = S.group_variants(spark.createDataFrame([(w,) for w in words], "word string"), min_length=4, min_count=2, ratio=5)
    assert result(got) == want


def test_very_long_words(spark):
    """A run of letters of 20,000 code points, and one without a letter of it: near words."""
    rng = random.Random(6)
    long = "".join(rng.choice("xyz") for _ in range(20_000))
    other = long[:12_345] + long[12_346:]
    words = spark.createDataFrame([(long,)] * 20 + [(other,)] * 2, "word string")
    assert result(S.group_variants(words)) == {long: (20, 1, None, None, long), other: (2, 1, long, 20, long)}


def test_runs_nulls_and_case(spark):
    docs = spark.createDataFrame([(1, "Straßen STRASSEN élève-ABC ÉLÈVE1abc", "x"), (2, None, "y"), (3, "", "z"), (None, "Ab×c", "w")],
                                 "doc_id long, text string, run string")
    got = sorted((r["doc_id"] or 0, r["run"]) for r in S.letter_runs(docs).collect())
    assert got == sorted([(0, "ab×c"), (1, "abc"), (1, "abc"), (1, "straßen"), (1, "strassen"), (1, "ÉlÈve"), (1, "élève")])


def test_ties_take_the_smaller_word(spark):
    words = spark.createDataFrame([("planter",)] * 2 + [("planted",)] * 20 + [("plantes",)] * 20, "word string")
    got = result(S.group_variants(words))
    assert got["planter"] == (2, 2, "planted", 20, "planted")
    assert got["plantes"] == (20, 2, None, None, "plantes")


def test_query_takes_out_letters_and_reads_odd_rows(spark, tmp_path):
    import zlib

    rows = [(i, f"wonderful wonderful {'w' * 9} été", 0) for i in range(300)] + [(None, "wonderful", 1), (7, None, 2), (7, "", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, word int").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for d, t, _ in rows:
        for w in (t or "").split():
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    assert len(counts) > 2
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in op13_permuterm(spark, str(tmp_path)).collect()}
    assert got == brute(counts, 10)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "word string")
    out = S.group_variants(empty)
    assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"] and out.count() == 0


def test_groups_are_bounded_by_the_alphabet(spark):
    """Many words around one hot word never meet in one group beyond one row a letter and a kind."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = [("abcdefg"[:i] + c + "abcdefg"[i + 1:],) for i in range(7) for c in alphabet for _ in range(2)]
    vocab = S.vocabulary(spark.createDataFrame(words, "word string"))
    most = S.rotations(vocab).groupBy("key").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0]
    assert most <= len(alphabet) + 1
