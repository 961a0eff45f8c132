"""Appends are all or nothing, and two writers never fill a shard twice."""

import csv
import tempfile

import pytest
from pyspark.sql import functions as F

from trawl.session import scratch_dir
from trawl.sources import manifest
from trawl.sources.corpustable import CorpusTable
from trawl.sources.files import read_flat_corpus


def _rows(spark, n, tag):
    return spark.createDataFrame([(i, "k", f"http://h/{tag}/{i:02d}", "t" * 80) for i in range(n)],
                                 "i int, keyword string, url string, text string")


def _sizes(table):
    return {r.shard: r.n for r in table.rows().groupBy("shard").agg(F.count("*").alias("n")).collect()}


def test_a_writer_that_stops_leaves_nothing(spark, monkeypatch):
    table = CorpusTable(spark, scratch_dir(spark, "corpus-stop"), 600)
    assert table.rows().count() == 0 and table.state() == (1, 0) and table.counters().count() == 0
    table.append(_rows(spark, 6, "a"), ["i"])
    before = table.state()

    def stop(*a):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(manifest, "publish", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            table.append(_rows(spark, 9, "lost"), ["i"])
    assert table.state() == before and table.rows().count() == 6
    table.append(_rows(spark, 6, "b"), ["i"])
    got = table.rows().orderBy("file_name", "row_pos").collect()
    assert sorted(r.url for r in got) == [f"http://h/{t}/{i:02d}" for t in "ab" for i in range(6)]
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    shared = [r.url[9] for r in got if r.shard == before[0]]
    assert shared == sorted(shared) and set(shared) == {"a", "b"}  # the last shard was filled up, in order of appends


def test_two_writers_never_fill_a_shard_twice(spark, monkeypatch):
    root = scratch_dir(spark, "corpus-two")
    table, other = CorpusTable(spark, root, 600), CorpusTable(spark, root, 600)
    real, came_first = manifest.publish, []

    def publish(*a):
        if not came_first:  # another writer publishes between the count and the commit
            came_first.append(True)
            other.append(_rows(spark, 5, "first"), ["i"])
        return real(*a)

    monkeypatch.setattr(manifest, "publish", publish)
    table.append(_rows(spark, 20, "second"), ["i"])
    one = CorpusTable(spark, scratch_dir(spark, "corpus-one"), 600)
    one.append(_rows(spark, 5, "first"), ["i"])
    one.append(_rows(spark, 20, "second"), ["i"])
    assert _sizes(table) == _sizes(one) and table.state() == one.state()
    assert table.rows().count() == 25
    got = table.counters().orderBy("append").collect()
    assert [r.rows for r in got] == [5, 20] and all(r.seconds > 0 and r.row_bytes > 0 for r in got)


def test_an_empty_append_changes_no_shard(spark):
    table = CorpusTable(spark, scratch_dir(spark, "corpus-none"), 600)
    table.append(_rows(spark, 3, "a"), ["i"])
    before = table.state()
    table.append(_rows(spark, 3, "a").where("i < 0"), ["i"])
    assert table.state() == before and table.rows().count() == 3


def test_flat_files_are_adopted_and_continued(spark):
    d = tempfile.mkdtemp(prefix="trawl-adopt-")
    for n in (1, 2, 10):
        with open(f"{d}/corpus_{n}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([["keyword", "url", "text"], *[["k", f"u{n}-{i}", 'a "b",\n' * 3] for i in range(3)]])
    open(f"{d}/corpus_x.csv", "w").write("keyword,url,text\nk,u,t\n")
    whole, small = (sorted(map(tuple, read_flat_corpus(spark, d, b).select("shard", "url", "text", "row_pos").collect()), key=str) for b in (1 << 20, 16))
    assert [r[:3] for r in whole] == [r[:3] for r in small] and len(whole) == 10
    by_place = [r[1] for r in sorted((r for r in small if r[0] == 10), key=lambda r: r[3])]
    assert by_place == ["u10-0", "u10-1", "u10-2"]
    row = len('k,u10-0,"' + 'a ""b"",\n' * 3 + '"') + 2
    table = CorpusTable(spark, scratch_dir(spark, "adopted"), limit_bytes=4 * row)
    assert table.adopt(d) == (10, 3 * row)
    rows = spark.createDataFrame([(i, "k", f"u11-{i}", 'a "b",\n' * 3) for i in range(3)], "i int, keyword string, url string, text string")
    table.append(rows, ["i"])
    table.append(rows, ["i"])
    got = {s: n for s, n in table.rows().groupBy("shard").count().collect()}
    assert got == {1: 3, 2: 3, 10: 4, 11: 4, 12: 1}
    assert table.rows().where("shard = 10").orderBy("file_name", "row_pos").collect()[-1].url == "u11-0"
    with pytest.raises(ValueError):
        table.adopt(d)
