"""Operator 3 against brute force: merged order, repeated starts, the query."""

import hashlib
import os

import numpy as np
import pytest

from trawl.llm import queries as Q
from trawl.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


def brute(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, r in enumerate(raw):
        for s in range(len(r) - length + 1):
            seen.setdefault(hashlib.blake2b(r[s:s + length], digest_size=16).digest(), []).append((i, s))
    cover = [np.zeros(len(r), bool) for r in raw]
    for at in seen.values():
        if len(at) > 1:
            for i, s in at:
                cover[i][s:s + length] = True
    out = []
    for r, c in zip(raw, cover):
        edges = np.diff(np.concatenate([[0], c.astype(int), [0]]))
        kept = bytes(np.frombuffer(r, np.uint8)[~c])
        out.append((len(r), int(c.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("shard", [1, 3, 100])
def test_merged_order_and_common_prefixes(shard):
    rnd = np.random.default_rng(shard)
    strings = [bytes(rnd.integers(97, 99, rnd.integers(1, 50)).astype(np.uint8)) for _ in range(60)]
    strings += [strings[0], strings[5], strings[5][:7], b"a" * 40, b"a" * 40, b"a" * 39, b"\x00\x01", bytes(range(1, 60))]
    order, lcp = S.sorted_suffixes(strings, shard)
    padded = [strings[i].ljust(64, b"\0") for i in order]
    assert padded == sorted(padded)
    assert sorted(order.tolist()) == list(range(len(strings)))
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = common(a, b)
        assert lcp[k] >= n and (lcp[k] == n or n == min(len(a), len(b)))  # past an end, padding may agree


def test_two_equal_strings_never_part():
    text = bytes(range(200))
    order, lcp = S.sorted_suffixes([text, text, text[:64]], 2)
    assert lcp[1:].max() >= 200 and sorted(order.tolist()) == [0, 1, 2]


def test_segments_cover_every_start():
    rnd = np.random.default_rng(0)
    data = rnd.integers(97, 101, 5000).astype(np.uint8)
    off = np.array([0, 399, 399, 800, 2500, 5000])
    text, lo, hi, base = S.segments(data, off)
    got = [(t, s) for t, a, b in zip(text, lo, hi) for s in range(a, b + 1)]
    assert got == [(i, s) for i in range(5) for s in range(off[i], off[i + 1] - 399)]
    assert ((base >= lo) & (base + S.HALF <= lo + 400) & (base >= hi)).all() and (base - lo < S.HALF).all()


def texts_for(rnd):
    word = lambda: "".join(chr(97 + k) for k in rnd.integers(0, 26, rnd.integers(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(90) for _ in range(4)]
    out = [None, "", "short", prose(300)]
    out += [out[3], out[3], prose(40) + shared[0] + prose(30), shared[0] + "é" + prose(20), prose(10) + shared[1] + prose(10) + shared[1]]
    near = prose(400)
    for _ in range(6):
        w = near.split(" ")
        for _ in range(rnd.integers(1, 6)):
            w[rnd.integers(0, len(w))] = word()
        out.append(" ".join(w))
    for _ in range(8):
        s = shared[rnd.integers(0, 4)]
        a, b = sorted(rnd.integers(0, len(s), 2))
        out.append(prose(rnd.integers(0, 30)) + s[a:b] + prose(rnd.integers(0, 30)))
    exact = prose(200)
    out += [exact[:400] + prose(20), prose(3) + exact[:400], exact[100:499] + prose(9), prose(4) + exact[100:499], exact[500:900] + "#", "$" + exact[500:901]]
    out += ["ab" * 500, "x" * 401, "y" * 400, "é" * 300, "ab" * 210 + prose(5)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = texts_for(np.random.default_rng(seed))
    docs = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, repeats string").repartition(3)
    out = S.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "repeats", "repeats_"]
    got = {}
    for r in out.collect():
        kept = bytes(r.repeats_.kept)
        got[r.doc_id] = (r.repeats_.n_bytes, r.repeats_.n_bytes - len(kept), len(r.repeats_.spans), hashlib.sha256(kept).hexdigest())
        assert r.text == texts[r.doc_id]
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in Q.op3_merged_bwt(spark, SF).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])


def test_repeated_rows_and_empty(spark):
    text = os.urandom(300).hex()
    docs = spark.createDataFrame([(1, text), (1, text), (None, text[:400]), (None, None)], "doc_id long, text string")
    got = sorted(len(r.repeats.kept) for r in S.remove_repeats(docs).collect())
    assert got == [0, 0, 0, 0]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_hot_key_is_not_one_task(spark, monkeypatch):
    """A passage in 60 texts, each with other surroundings: no task merges a key with more than CHUNK segments."""
    limit, real = 8, S._merge
    monkeypatch.setattr(S, "CHUNK", limit)

    def watched(batches):
        batches = list(batches)
        kinds = {}
        for b in batches:
            for k, seg in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kinds.setdefault(k, set()).add(seg)
        assert max(map(len, kinds.values()), default=0) <= limit
        yield from real(iter(batches))

    monkeypatch.setattr(S, "_merge", watched)
    rnd = np.random.default_rng(4)
    passage = bytes(rnd.integers(97, 123, 700).astype(np.uint8)).decode()
    texts = texts_for(rnd)
    for _ in range(60):
        a, b = rnd.integers(0, 120, 2)
        around = bytes(rnd.integers(97, 123, 900).astype(np.uint8)).decode()
        texts.append(around[:450] + passage[a:700 - b] + around[450:])
    texts.append(texts[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in S.remove_repeats(docs).collect():
        kept = bytes(r.repeats.kept)
        got[r.doc_id] = (r.repeats.n_bytes, r.repeats.n_bytes - len(kept), len(r.repeats.spans), hashlib.sha256(kept).hexdigest())
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_planted_passages_go_from_400_bytes_on(spark):
    """A passage in three texts goes in full if it has 400 bytes, and stays if it has fewer."""
    rnd = np.random.default_rng(11)

    def words(n):
        return "".join(chr(c) for c in rnd.integers(97, 123, n))

    sizes = [300, 350, 399, 400, 401, 500, 1000, 2000]
    planted = [words(n) for n in sizes]
    rows = [(i * 3 + j, words(700) + "ABC"[j] + p + "XYZ"[j] + words(300)) for i, p in enumerate(planted) for j in range(3)]
    rows.append((900, words(3000)))
    out = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), keep=["doc_id"])
    got = {r.doc_id: sum(s.end - s.start for s in r.repeats.spans) for r in out.collect()}
    assert got == {900: 0, **{i * 3 + j: n if n >= 400 else 0 for i, n in enumerate(sizes) for j in range(3)}}


def test_hot_key_merged_over_parts(spark):
    """Names of intervals over many parts say what one sort says."""
    rnd = np.random.default_rng(9)
    stem = bytes(rnd.integers(97, 123, 420).astype(np.uint8))
    rights = {stem}
    for _ in range(150):  # texts that part from the stem anywhere, some at once after it
        at = int(rnd.integers(200, 400))
        rights.add(stem[:at] + bytes(rnd.integers(97, 99, int(rnd.integers(0, 400 - at + 1))).astype(np.uint8)).ljust(210 - at, b"a"))
    rights = sorted(r for r in rights if len(r) >= 201)
    rows = [(7, bytearray(r), 2 if i % 9 == 0 else 1) for i, r in enumerate(rights)] + [(8, bytearray(stem), 1)]
    df = spark.createDataFrame(rows, "key long, right binary, total long").repartition(4)
    for chunk in (1, 5, 1000):
        got = {(r.key, bytes(r.right)): np.frombuffer(bytes(r.names), "<i8") for r in S.merged_intervals(df, chunk).collect()}
        assert len(got) == len(rows)
        for k, t in enumerate(S.DEPTHS.tolist()):
            name, members = {}, {}
            for r in rights:
                if len(r) >= t:
                    members.setdefault(r[:t], []).append(r)
            for stem_, some in members.items():
                names = {int(got[7, r][k]) for r in some}
                assert len(names) == 1  # one interval, one name
                if len(some) > 1:
                    assert -1 not in names
                for x in names - {-1}:
                    assert name.setdefault(x, stem_) == stem_  # other interval, other name


def test_passage_in_a_third_of_many_texts(spark, monkeypatch):
    """A passage in a third of 1,500 texts, each with other surroundings: equal to brute force."""
    monkeypatch.setattr(S, "CHUNK", 100)
    rnd = np.random.default_rng(21)

    def words(n):
        return "".join(chr(c) for c in rnd.integers(97, 123, n))

    passage = words(600)
    texts = [words(120) + passage + words(230) if i % 3 == 0 else words(450) for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.repeats.n_bytes, r.repeats.n_bytes - len(r.repeats.kept), len(r.repeats.spans), hashlib.sha256(bytes(r.repeats.kept)).hexdigest())
           for r in S.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
