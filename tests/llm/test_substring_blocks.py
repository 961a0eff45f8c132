"""Substring dedup against every window of every document."""

import hashlib
import random

import numpy as np
import pytest

from trawl.llm import substring_blocks as B
from trawl.llm.queries import op12_block_anchors


def brute(rows, window=50):
    """Rows ``(doc_id, text)`` to the kept text and the spans of each."""
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i:i + window])] < d:
                    gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def result(df):
    return [(r["doc_id"], r["repeats"]["n_words"], sum(s["end"] - s["start"] for s in r["repeats"]["spans"]), r["repeats"]["kept"])
            for r in df.collect()]


def order(v):
    return (v[0] is None, v[0] or 0, *v[1:])


def corpus(seed, docs, vocabulary):
    """Own words, passages of 40 to 120 words, copies and copies with an edit."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(vocabulary))
    passages = [[word() for _ in range(n)] for n in (40, 49, 50, 51, 60, 75, 120)]
    rows = []
    for i in range(docs):
        if rows and rng.random() < 0.3:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = word()
        else:
            w = []
            for _ in range(rng.randint(0, 4)):
                w += [word() for _ in range(rng.randint(0, 80))]
                p = rng.choice(passages)
                a = rng.randint(0, 5)
                w += p[a:len(p) - rng.randint(0, 5)]
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,vocabulary", [(1, 6), (2, 1)])
def test_equals_every_window(spark, seed, vocabulary):
    """Words of 6 letters, and of 1 (few different words, so short runs repeat everywhere)."""
    rows = corpus(seed, 120, vocabulary)
    want = sorted(brute(rows), key=order)
    assert sum(v[2] > 0 for v in want) > 20 and sum(v[2] == 0 for v in want) > 20
    got = result(B.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert sorted(got, key=order) == want


def test_odd_rows_and_clashing_names(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (1, passage), (1, f"x {passage} y"), (2, None), (3, ""), (4, " \n\t"), (None, passage), (None, f"z {passage}"),
            (5, f"a\n\n{passage}\tb"), (6, " ".join(["q"] * 300)), (7, " ".join(["q"] * 49)), (8, " ".join(["q"] * 120) + " end")]
    df = spark.createDataFrame([(*r, "s", 1, "p") for r in rows], "doc_id long, text string, start string, repeats int, _text string")
    out = B.remove_repeats(df)
    assert out.columns == [*df.columns, "repeats_"]
    got = [(r["doc_id"], r["repeats_"]["n_words"], sum(s["end"] - s["start"] for s in r["repeats_"]["spans"]), r["repeats_"]["kept"])
           for r in out.collect()]
    assert sorted(got, key=order) == sorted(brute(rows), key=order)
    assert {(r["start"], r["repeats"], r["_text"]) for r in out.collect()} == {("s", 1, "p")}
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(str(t) for _, t in rows)


def test_one_passage_in_a_third_of_all(spark):
    """Different words around it in every document."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(64)]
    rows = [(i, " ".join([f"{i}a{j}" for j in range(rng.randint(0, 70))] + (passage if i % 3 == 0 else []) +
                         [f"{i}b{j}" for j in range(rng.randint(0, 70))])) for i in range(900)]
    got = result(B.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)))
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_very_long_text(spark):
    rng = random.Random(4)
    long = [str(rng.randrange(10**9)) for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[70_000:70_049])), (3, " ".join(["x", *long[99_000:99_050], "y"])),
            (4, " ".join([*long[:60_000], "cut", *long[60_000:]]))]
    got = {d: (n, r) for d, n, r, _ in result(B.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {1: (150_000, 0), 2: (49, 0), 3: (52, 50), 4: (150_001, 150_000)}


def test_empty_table_and_query(spark, tmp_path):
    rows = corpus(9, 40, 6)
    for name, part in (("none", []), ("some", rows)):
        spark.createDataFrame(part, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        want = [(d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in brute(part)]
        assert sorted(map(tuple, op12_block_anchors(spark, f"{tmp_path}/{name}").collect())) == sorted(want)


def test_smallest_of_strided_values():
    v = np.random.default_rng(0).integers(0, 9, 200).astype(np.uint64)
    for width, stride in ((1, 1), (5, 1), (4, 10), (7, 3)):
        best, at = B.smallest(v, width, stride)
        for i in range(len(v) - (width - 1) * stride):
            run = v[i:i + (width - 1) * stride + 1:stride]
            assert best[i] == run.min() and at[i] == i + int(np.argmin(run)) * stride
        assert len(best) == len(v) - (width - 1) * stride
