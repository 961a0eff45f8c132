"""Operator 9: round trips against plain encoding and plain splitting."""

import numpy as np
import pytest

from trawl.llm import queries as Q
from trawl.llm import separator_scan as S

SF = "/root/testdata/sf0.001"


def test_query_counts_each_document(spark):
    enc = S.tokenizer(S.VOCABULARY)
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in Q.op9_separator_scan(spark, SF).collect()}
    assert got == {r.doc_id: len(enc.encode_ordinary(r.text)) for r in rows}


def plain(flat, sep):
    out, start = [], 0
    for i, t in enumerate(flat):
        if t == sep:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(flat):
        out.append((len(out), start, len(flat) - start, False))
    return out


@pytest.mark.parametrize("segment", [1024, 3])
def test_streams_of_files(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)
    rnd = np.random.default_rng(segment)
    flats = {"a": rnd.integers(0, 9, 700), "b": np.full(50, 7), "c": np.array([], int), "d": np.array([8]), "e": np.full(30, 8),
             "f": np.concatenate([np.full(90, 3), [8], np.full(41, 2), [8]])}
    for name, flat in flats.items():
        flat.astype("<u2").tofile(tmp_path / name)
    got = S.count_tokens(S.token_files(spark, str(tmp_path), block=10, width=2), separator=8).collect()
    for name, flat in flats.items():
        mine = sorted((r.ordinal, r.start, r.n_tokens, r.terminated) for r in got if r.file.endswith("/" + name))
        assert mine == plain(flat.tolist(), 8), name


def test_edge_rows(spark):
    texts = [None, "", "<|endoftext|>", "a b", "a b", "word " * 20000, "é" * 5000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "a b", 5)], "doc_id long, text string, file int").coalesce(1)
    enc = S.tokenizer(S.VOCABULARY)
    for block in (7, 1 << 18):
        got = {r.ids: r.n_tokens for r in S.count_tokens(S.encode_documents(docs, block=block)).collect()}
        assert got == {**{i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}, None: 2}
    assert S.count_tokens(S.encode_documents(docs.limit(0))).count() == 0


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    ids = np.random.default_rng(1).integers(0, 9, 50_021).astype("<u2")
    ids.tofile(tmp_path / "a b.bin")
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = S.token_files(spark, str(tmp_path), block=1000, width=2)
    got = blocks.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 1
    flat = b"".join(bytes(r.data) for r in sorted(got, key=lambda r: r.block))
    assert (np.frombuffer(flat, "<u4") == ids).all() and len(got) == 51
    # the way for stores without local files
    store = S._store_file(spark, f"file:{tmp_path}/a b.bin", 2 * len(ids), 1000, 2).collect()
    size = S.record_bytes(2 * len(ids), 1000, 2)
    assert 2 * len(ids) % size == 0 and size <= 2000 and len(store) == 2 * len(ids) // size
    assert b"".join(bytes(r.data) for r in sorted(store, key=lambda r: r.block)) == flat
    counts = lambda df: sorted(tuple(r)[1:] for r in S.count_tokens(df, separator=3).collect())
    assert counts(blocks) == counts(S._store_file(spark, f"file:{tmp_path}/a b.bin", 2 * len(ids), 1000, 2))
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError, match="odd.bin"):
        S.token_files(spark, str(tmp_path), width=2)
