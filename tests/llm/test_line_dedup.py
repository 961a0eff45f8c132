"""Operator 6 against brute force, and its edge rows."""

import random

import pytest

from trawl.llm import line_dedup as L


def words(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line).split(None) if line.isascii() else [
        x for x in "".join(" " if c in " \t\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in line).split(" ") if x]


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    p = 0
    while p < len(b) and a[p] == b[p]:
        p += 1
    return a[p + 1:] == b[p + (len(a) == len(b)):]


def brute(rows, fuzzy=6):
    lines = sorted(((d is None, d or 0, i, words(x)) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))))
    firsts, gone = {}, set()
    for no, d, i, w in lines:
        if not w:
            continue
        k = tuple(w)
        if k in firsts:
            gone.add((no, d, i))
        else:
            firsts[k] = (no, d, i)
    items = list(firsts.items())
    for a, pa in items:
        for b, pb in items:
            if pb < pa and a != b and max(len(a), len(b)) >= fuzzy and one_edit(list(a), list(b)):
                gone.add(pa)
    return [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d is None, d or 0, i) not in gone))
            for d, t in rows]


def mutate(rnd, line):
    w = line.split(" ")
    for _ in range(rnd.choice([0, 1, 1, 2])):
        p = rnd.randrange(len(w))
        w[p:p + 1] = rnd.choice([[], ["new"], [w[p], "more"], ["x"]])
        w = w or ["z"]
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(4)] + ["Été", "ÀB", "Zz"]
    base = [" ".join(rnd.choices(vocab, k=rnd.randint(1, 14))) for _ in range(60)]
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(mutate(rnd, rnd.choice(base)) for _ in range(rnd.randint(1, 6)))))
    rnd.shuffle(rows)
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = dict(brute(rows))
    assert {r.doc_id: r.text for r in out} == want
    for r in out:
        text = dict(rows)[r.doc_id]
        assert r.lines.n_lines == len(text.split("\n"))


def test_edge_rows(spark):
    line = "one two three four five six seven"
    rows = [(3, None), (4, ""), (5, "\n\n"), (6, f"{line}\n\nA b\n{line.upper()}"), (7, f"a  b\r\n{line} eight"), (8, "one two three four five six\nnothing like it at all here"),
            (9, "one two three four five"), (None, f"{line}\nlast words"), (10, "w " * 40000), (11, "w " * 40000 + "v")]
    docs = spark.createDataFrame([(d, t, "q", 3) for d, t in rows] + [(8, rows[5][1], "q", 3)], "doc_id long, text string, lines string, n_chars int")
    out = L.dedup_lines(docs)
    assert out.columns == [*docs.columns, "lines_"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.count() == 11
    assert got == {3: None, 4: "", 5: "\n\n", 6: f"{line}\n\nA b", 7: "", 8: "nothing like it at all here", 9: "",
                   None: "last words", 10: "w " * 40000, 11: ""}
    kept = L.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.n_chars) for r in kept.collect()) == [(0, 10), (3, 3), (4, 0), (5, 2), (6, len(line) + 5), (8, 27), (8, 27), (10, 80000)]
    assert L.dedup_lines(docs.limit(0)).count() == 0
