"""Operator 1: the query against its SQL, edge rows, blocks."""

import hashlib

import numpy as np
import pytest

from trawl.llm import decontaminate as D
from trawl.llm import queries as Q

SF = "/root/testdata/sf0.001"


def slow(texts, items, window=10):
    import re

    pat = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: pat.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    wins = []
    for i, t in items:
        w = low(t)
        n = min(window, len(w))
        wins += [(i, tuple(w[k:k + n])) for k in range(len(w) - n + 1)] if n else []
    for t in texts:
        w = low(t)
        hit, ids = set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k:k + len(x)]) == x:
                    ids.add(str(i))
                    hit.update(range(k, k + len(x)))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return out


def digest(df):
    items = D.items_of("match.matches")
    from pyspark.sql import functions as F

    return df.select("doc_id", "match.n_words", D.n_hit("match.matches").alias("h"), F.size(items).alias("k"),
                     F.sha2(F.array_join(items, ","), 256).alias("s"), "match.matches")


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_edge_rows_and_blocks(spark, block_bytes):
    ten = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j0"
    items = [(1, ten + " k1 l2"), (2, "Été ñandú"), (3, None), (4, "..."), (None, "x y z"), (10, "zz"), (11, ten)]
    texts = [None, "", "!!!", f"pre {ten.upper()}-k1, L2 post", f"{ten} {ten}", "ÉTÉ ñandú", "été ñandú zz zz", "x y z",
             "b2 c3 d4 e5 f6 g7 h8 i9 j0 k1 l2", "a1 " * 20000 + ten, f"{ten}"]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(4, texts[4], "m"), (None, ten, "m")],
                                 "doc_id long, text string, match string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.find_matches(docs, bench, 10, block_bytes)
    assert out.columns == ["doc_id", "text", "match", "match_"]
    rows = digest(D.find_matches(docs.drop("match"), bench, 10, block_bytes)).collect()
    want = slow(texts, [x for x in items if x[0] is not None])
    assert len(rows) == len(texts) + 2
    for r in rows:
        i = 10 if r.doc_id is None else r.doc_id
        assert (r.n_words, r.h, r.k, r.s) == want[i], (i, r)
    longest = {r.doc_id: max([m.words for m in r.matches], default=0) for r in rows}
    assert longest[3] == 12 and longest[8] == 11
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 5, 7]
    assert D.find_matches(docs.limit(0), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == len(texts) + 2


def test_random_shards(spark):
    rnd = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rnd.integers(0, 3, rnd.integers(0, 60))) for _ in range(40)]
    items = [(i, " ".join(f"w{k}" for k in rnd.integers(0, 3, n))) for i, n in enumerate([1, 2, 3, 6, 7, 9, 12, 15])]
    for window in (3, 6):
        rows = digest(D.find_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"), window)).collect()
        want = slow(texts, items, window)
        assert [(r.n_words, r.h, r.k, r.s) for r in sorted(rows)] == want


def test_query_columns(spark):
    df = Q.op1_suffix_search(spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint",
                               "items_sha256": "string", "contaminated": "boolean"}
    assert df.where("contaminated").count() > 0
