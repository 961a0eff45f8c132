"""Operator 10 against brute force: links, counts, components, recall."""

import numpy as np
import pytest

from trawl.llm import embed_dedup as E
from trawl.llm import queries as Q


def brute(rows, threshold=0.93):
    good = [i for i, (_, e, lab) in enumerate(rows)
            if lab is not None and e and all(c is not None and np.isfinite(c) for c in e) and any(c for c in e)]
    links = {i: [] for i in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.asarray(rows[k][1], np.float32).astype(float) for k in (a, b))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[a].append(b)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out.append((rows[i][0], len(links[i]), min(rows[k][0] for k in seen)))
    return out


@pytest.mark.parametrize("split", [4096, 7])
def test_against_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(E, "SPLIT", split)
    rnd = np.random.default_rng(3)
    rows = []
    for c in range(12):
        base = rnd.normal(size=48)
        for _ in range(20):
            rows.append(base + rnd.normal(size=48) * rnd.uniform(0, 0.5))
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 2 if i < 100 else 0)) for i, v in enumerate(rows)]
    k = len(rows)
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 0), (k + 2, rows[0][1], None), (k + 3, None, 0), (k + 4, [0.0] * 48, 0),
             (k + 5, [1.0, None], 0), (k + 6, [float("nan")] * 48, 0), (k + 7, [], 0), (k + 8, [1.0, 2.0], 0), (k + 9, [2.0, 4.0], 0),
             (k + 10, [5.0], 1), (k + 11, [7.0], 1), (k + 12, [float("inf")] * 48, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicate_vectors(df).collect())
    assert got == sorted(brute(rows))


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [1.0, 0.0], 3), (5, [0.0, 1.0], 3)],
                               "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in E.near_duplicate_vectors(df).collect())
    assert got == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (5, 0, 5, True)]
    assert E.near_duplicate_vectors(df.limit(0)).count() == 0


def test_recall_on_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in Q.op10_cross_polytope(spark, sf).collect()}
    want = brute(rows)
    assert sum(got[v][0] for v, _, _ in want) >= 0.999 * sum(n for _, n, _ in want)
    assert all(got[v][0] <= n for v, n, _ in want)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(E.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(E.hadamard(E.hadamard(x)), x)


def test_linked_pairs_are_folded_group_by_group():
    """A task with ten fully linked groups (about 4.5 million pairs) holds neither all rows nor all pairs."""
    import tracemalloc

    import pyarrow as pa

    groups, size, dim = 10, 950, 8
    unit = np.zeros(dim)
    unit[0] = 1.0
    home = np.zeros((E.TABLES, E.CODES), np.int64)
    home[:, 1:] = -1

    def batches():
        for g in range(groups):
            code = np.where(home == 0, g, home).ravel()
            yield pa.RecordBatch.from_pydict({
                "rid": np.arange(size) + g * size, "label": np.zeros(size, np.int64), "n": np.ones(size, np.int64),
                "dim": np.full(size, dim, np.int32), "unit": [unit.tobytes()] * size, "codes": [code] * size,
                "bucket": np.full(size, g), "tbl": np.zeros(size, np.int64), "probe": np.zeros(size, np.int64),
                "block": np.zeros(size, np.int64), "i": np.zeros(size, np.int64), "j": np.zeros(size, np.int64)})

    tracemalloc.start()
    out = list(E._compare(0.93)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    links = sum(sum(b.column(1).to_pylist()) for b in out)
    assert links == groups * size * (size - 1)
    assert peak < 100 << 20


def test_comparing_tasks_grow_with_the_dealt_rows(spark, monkeypatch):
    monkeypatch.setattr(E, "SPLIT", 10)
    monkeypatch.setattr(E, "TASK_ROWS", 400)
    tasks, real = {}, E.cut

    def cut(df, name="cut"):
        if name == "vector_links":
            tasks[name] = df.rdd.getNumPartitions()
        return real(df, name)

    monkeypatch.setattr(E, "cut", cut)
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in base + rnd.normal(size=16) * 0.01], 0) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicate_vectors(df).collect())
    assert got == [(i, 99, 0) for i in range(100)]
    # 2,400 rows before dealing are 6 tasks; 8 tables of 100 at home, dealt 10 times, need 20 alone
    assert tasks["vector_links"] >= 20


def test_labels_as_they_are_and_extreme_components(spark):
    """Labels of any type are compared, not cast; components whose squares leave the range of doubles."""
    base = [1.0, 2.0, 3.0, 4.0]
    for kind, same, other in (("double", 1.2, 1.7), ("string", "a", "b"), ("int", 1, 2)):
        rows = [(1, base, same), (2, base[:3] + [4.1], same), (3, base, other)]
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicate_vectors(df).collect()}
        assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    far = [1.0, -2.0, 3.0, 0.5]
    for scale in (1e-200, 1e200, 1e-308):
        rows = [(1, [v * scale for v in base], 0), (2, [v * scale for v in base[:3]] + [4.1 * scale], 0), (3, [v * scale for v in far], 0)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicate_vectors(df).collect()}
        assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
