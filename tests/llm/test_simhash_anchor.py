"""Operator 2 against brute force: fingerprints, links and components."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trawl.llm import queries as Q
from trawl.llm import simhash_anchor as S
from trawl.llm.components import components, local_forest

SF = "/root/testdata/sf0.001"


def slow_simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, t):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= t:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), 1 << 60), ids[i])
    return {ids[i]: low[find(i)] for i in range(len(ids))}


def test_golay_cosets_cover_every_word_once():
    rem, _, classes = S._cosets(2)
    pats, start, count = classes[0]
    assert (count == 1).all()  # perfect: one codeword within 3 of every word
    x = np.array([random.getrandbits(22) for _ in range(200)])
    assert (S.syndrome(x ^ pats[start[S.syndrome(x, rem)]], rem) == 0).all()


@pytest.mark.parametrize("t", [1, 3, 4])
def test_every_link_meets_at_a_home_anchor(t):
    rnd = random.Random(t)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = list(base)
    for b in base:
        for _ in range(6):
            fps.append(b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, t + 1))))
    fps = np.array(sorted(set(fps)), np.uint64)
    anchors, owners = [], []
    for row, a, home in S.replicas(fps, t):
        anchors.append((a | (home << 26)).astype(np.uint32))
        owners.append(row)
    u, v = S.links_of_bucket(np.concatenate(anchors), fps[np.concatenate(owners)], t, pairs=500)
    got = {}
    root = {int(x): int(x) for x in fps.view(np.int64)}
    for a, b in zip(u.tolist(), v.tolist()):
        root[a] = b
    want = slow_components(list(range(len(fps))), [int(x) for x in fps], t)
    signed = fps.view(np.int64).tolist()
    groups = {}
    for i, s in enumerate(signed):
        while root[s] != s:
            s = root[s]
        groups.setdefault(s, set()).add(i)
    got = {frozenset(g) for g in groups.values()}
    wanted = {}
    for i, c in want.items():
        wanted.setdefault(c, set()).add(i)
    assert got == {frozenset(g) for g in wanted.values()}


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = [slow_simhash(r.text) for r in rows]
    want = slow_components([r.doc_id for r in rows], fps, 4)
    got = {r.doc_id: r for r in Q.op2_simhash_anchor(spark, SF).collect()}
    assert len(got) == len(rows)
    for r, f in zip(rows, fps):
        assert got[r.doc_id].fingerprint == f"{f:016x}"
        assert got[r.doc_id].component_id == want[r.doc_id]


def test_edge_rows(spark):
    long = "word " * 30000
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t ", "x"), (4, "Ab c", "x"), (5, "aB\nc", "x"), (None, "aB\nc", "x"),
            (7, long, "x"), (8, long, "x"), (8, long, "x"), (9, "eins zwei drei vier fünf sechs", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.component_id) for r in S.near_duplicates(docs.drop("fp")).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (7, 7), (8, 7), (8, 7), (9, 9)], key=str)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 7, 9]
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (7, 7)] + [(1000, 1000 + i) for i in range(1, 60)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert {got[i] for i in range(1, 41)} == {1}
    assert got[300] == 100 and got[1059] == 1000 and len(got) == 40 + 3 + 60
    assert components(links.where(F.lit(False))).count() == 0


def test_local_forest():
    u, v = local_forest(np.array([5, 4, 9]), np.array([4, 3, 8]))
    assert dict(zip(u.tolist(), v.tolist())) == {4: 3, 5: 3, 9: 8}


def near_cluster():
    """2,081 fingerprints, all within 4 bits of each other."""
    base = random.Random(5).getrandbits(64)
    flips = [0] + [1 << a for a in range(64)] + [1 << a | 1 << b for a in range(64) for b in range(a)]
    return np.array([base ^ f for f in flips], np.uint64)


def test_linked_pairs_are_folded():
    """4.3 million linked pairs at one anchor are never held at once."""
    import tracemalloc

    fps = near_cluster()
    tracemalloc.start()
    u, v = S.links_of_bucket(np.full(len(fps), 7 | 1 << 26, np.uint32), fps, 4, pairs=1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(u) == len(fps) - 1 and len(set(v.tolist())) == 1
    assert peak < 32 << 20


def test_hot_anchors_are_dealt_as_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "SPLIT", 100)
    monkeypatch.setattr(S, "SAMPLE", 2)
    far = random.Random(6)
    fps = np.unique(np.concatenate([near_cluster(), np.array([far.getrandbits(64) for _ in range(200)], np.uint64)]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    packed, _ = S.packed_replicas(table, len(fps))
    most = 0
    for r in packed.groupBy("bucket").agg(F.flatten(F.collect_list(F.array("anchors"))).alias("a")).collect():
        anchors = np.concatenate([np.frombuffer(x, np.uint32) for x in r.a]) & np.uint32((1 << 26) - 1)
        most = max(most, int(np.unique(anchors, return_counts=True)[1].max()))
    assert most <= 400  # two blocks, as the sample tells them; an anchor alone has over 1,000
    comp = {r.node: r.component for r in components(S.fingerprint_links(table, len(fps))).collect()}
    cluster = near_cluster().view(np.int64).tolist()
    assert {comp[x] for x in cluster} == {min(cluster)} and len(comp) == len(cluster)
