"""The row queue: order, batches across files, restarts."""

import csv
import os

from trawl.session import scratch_dir
from trawl.sources import rowqueue
from trawl.sources.rowqueue import _QueueReader, keyword_queue
from trawl.streaming.intake import batch_counters, read_intake, run_intake


def _drop(folder, name, words, when):
    tmp = folder / f".{name}"
    with open(tmp, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["words"])
        w.writerows([[x, "more"] for x in words])
    os.utime(tmp, (1_700_000_000 + when, 1_700_000_000 + when))
    os.rename(tmp, folder / name)


def _rows(reader, start, end):
    return [r[0] for p in reader.partitions(start, end) for r in reader.read(p)]


def test_batches_are_rows_whatever_the_files(tmp_path):
    words = [f'k{i}\n"{i}"' if i % 3 else f"k{i}" for i in range(50)]
    _drop(tmp_path, "b.csv", words[:20], 1)
    _drop(tmp_path, "a.csv", words[20:21], 2)
    _drop(tmp_path, "c.csv", [], 3)
    _drop(tmp_path, "d.csv", words[21:], 3)
    reader = _QueueReader(str(tmp_path), 7, "UTF-8")
    got, at = [], reader.initialOffset()
    while True:
        to = reader.latestOffset()
        if to == at:
            break
        batch = _rows(reader, at, to)
        assert 0 < len(batch) <= 7
        got, at = got + batch, to
        reader = _QueueReader(str(tmp_path), 7, "UTF-8")  # restarted: told its place by the engine
        assert reader.partitions(at, at) == []
    assert got == words


def test_a_large_file_keeps_its_order_and_rows_are_numbered(tmp_path, monkeypatch):
    monkeypatch.setattr(rowqueue, "ROWS_PER_TASK", 150_000)
    n = 1_200_000
    with open(tmp_path / "big.csv", "w") as f:
        f.write("words\n")
        f.writelines(f"w{i}\n" for i in range(n))
    reader = _QueueReader(str(tmp_path), 1_100_000, "UTF-8")
    first = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), first)
    assert len(parts) == 8 and first["row"] == 1_100_001
    last = list(reader.read(parts[-1]))[-1]
    assert (last[0], last[3]) == ("w1099999", 1_100_000)
    second = reader.latestOffset()
    rest = [r for p in reader.partitions(first, second) for r in reader.read(p)]
    assert rest[0][0] == "w1100000" and rest[0][3] == 1_100_001 and len(rest) == n - 1_100_000
    assert reader.latestOffset() == second


def test_intake_pops_rows_and_goes_on_after_restarts(spark, tmp_path):
    seeds = spark.createDataFrame([("elma", 0, "http://h/e"), ("armut", 1, "http://h/a"), ("erik", 2, "http://h/x")],
                                  "keyword string, pos long, url string")
    out = scratch_dir(spark, "queue-out")
    _drop(tmp_path, "kw_1.csv", ["zeytin", "elma", "  armut "], 1)
    q = run_intake(spark, keyword_queue(spark, str(tmp_path), 2), seeds, out, drain=True)
    done = batch_counters(spark, q).orderBy("batch").collect()
    assert [r.rows for r in done] == [2, 1] and all(r.seconds > 0 for r in done)
    _drop(tmp_path, "kw_0.csv", ["kiraz", "", "ayva"], 2)  # a smaller name, but later
    run_intake(spark, keyword_queue(spark, str(tmp_path), 2), seeds, out, drain=True)
    run_intake(spark, keyword_queue(spark, str(tmp_path), 2), seeds, out, drain=True)  # nothing new
    kws = [r.keyword for r in read_intake(spark, out, "keywords").orderBy("seq").collect()]
    assert kws == ["zeytin", "elma", "armut", "kiraz", "ayva"]
    assert sorted(r.url for r in read_intake(spark, out, "seeds").collect()) == ["http://h/a", "http://h/e"]


def test_a_batch_without_a_lookup_is_one_job(spark, tmp_path):
    out = scratch_dir(spark, "queue-out")
    _drop(tmp_path, "kw_1.csv", ["zeytin", " \u2003elma\x1c", "\u3000 ", "armut", "ayva"], 1)
    q = run_intake(spark, keyword_queue(spark, str(tmp_path), 2), None, out, drain=True)
    assert [r.rows for r in batch_counters(spark, q).orderBy("batch").collect()] == [2, 2, 1]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(q.runId))) == 3
    assert [r.keyword for r in read_intake(spark, out, "keywords").orderBy("seq").collect()] == ["zeytin", "elma", "armut", "ayva"]
    seeds = read_intake(spark, out, "seeds")
    assert seeds.count() == 0 and seeds.dtypes == [("keyword", "string"), ("pos", "bigint"), ("url", "string")]
    # the same root goes on with a lookup
    _drop(tmp_path, "kw_2.csv", ["kiraz"], 2)
    found = spark.createDataFrame([("kiraz", 0, "http://h/k")], "keyword string, pos long, url string")
    run_intake(spark, keyword_queue(spark, str(tmp_path), 2), found, out, drain=True)
    assert read_intake(spark, out, "keywords").count() == 5
    assert [tuple(r) for r in read_intake(spark, out, "seeds").collect()] == [("kiraz", 0, "http://h/k")]


def test_runs_from_another_working_directory(tmp_path):
    """Neither blocks nor the queue need the package on the workers' or the planner's path."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("words\nx\ny\nz\n")
    code = f"""
import sys
sys.path.insert(0, {root!r})
from trawl.session import local_session, scratch_dir
from trawl.sources.files import read_keyword_csv
from trawl.sources.rowqueue import keyword_queue
from trawl.streaming.intake import read_intake, run_intake
spark = local_session("2", 2)
assert read_keyword_csv(spark, "in", block_bytes=4).count() == 3
out = scratch_dir(spark, "o")
none = spark.createDataFrame([], "keyword string, pos long, url string")
run_intake(spark, keyword_queue(spark, {str(tmp_path / "in")!r}, 2), none, out, drain=True)
assert [r.keyword for r in read_intake(spark, out, "keywords").orderBy("seq").collect()] == ["x", "y", "z"]
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=180)
