"""Files read by blocks equal the whole file read at once, wherever the block edges fall."""

import csv
import io
import json
import random

import pytest

from trawl.sources import files as IO
from trawl.sources import splits


def _cells(rng):
    pool = ["a", "bb", 'say "x"', "two\nlines", "crlf\r\nin", '"', '""', "c,d", "", "  pad ", "é€漢", '"\n"\n"', "x" * 300]
    return [rng.choice(pool), rng.choice(pool) or "k", rng.choice(pool)]


def _csv_file(path, rows, encoding="utf-8", end=True):
    text = io.StringIO(newline="")
    w = csv.writer(text)
    w.writerow(["words", "b", "c"])
    w.writerows(rows)
    body = text.getvalue()
    path.write_bytes((body if end else body.rstrip("\r\n")).encode(encoding))


@pytest.mark.parametrize("block", [1, 7, 64, 1000, 1 << 20])
def test_csv_blocks_equal_the_whole_file(tmp_path, block):
    rng = random.Random(block)
    for n in range(20):
        p = tmp_path / f"{n}.csv"
        rows = [_cells(rng) for _ in range(rng.randrange(0, 30))]
        _csv_file(p, rows, end=n % 2 == 0)
        size, got, quotes = p.stat().st_size, [], 0
        with open(p, "rb") as f:
            for start in range(0, size, block):
                end = min(start + block, size)
                got += splits.csv_rows(splits.csv_body(f, start, end, size, quotes % 2), "utf-8", start == 0)
                quotes += splits._csv_scan(f, start, end)[0]
        with open(p, newline="", encoding="utf-8") as f:
            assert got == [r for r in csv.reader(f) if r][1:]


@pytest.mark.parametrize("block", [1, 5, 64, 1000, 1 << 20])
def test_json_blocks_equal_the_whole_file(tmp_path, block):
    rng = random.Random(block)
    pool = ["w", 'q"q', "back\\", "\\\\", '\\"', "br{ace}", "[x]", "], [{", "é漢", "", "\n"]
    for n in range(20):
        items = [{"word": rng.choice(pool), "in": [{"d": rng.choice(pool)}, []]} for _ in range(rng.randrange(0, 20))]
        mixed = [x for i in items for x in (i, rng.choice([None, 3, "text {", [1], ["n", {"deep": 1}]]))]
        p = tmp_path / f"{n}.json"
        p.write_text(json.dumps(mixed, ensure_ascii=n % 2 == 0, indent=n % 3 or None), encoding="utf-8")
        size, got, quoted, depth = p.stat().st_size, [], 0, 0
        with open(p, "rb") as f:
            for start in range(0, size, block):
                end = min(start + block, size)
                got += [json.loads(o) for [o] in splits.json_objects(f, start, end, size, quoted, depth)]
                flips, outside, inside = splits._json_scan(f, start, end)
                depth += inside if quoted else outside
                quoted = (quoted + flips) % 2
        assert got == items


def test_one_large_csv_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    rows = [[f"k{i}", *_cells(rng)[1:]] for i in range(3000)]
    (tmp_path / "in").mkdir()
    _csv_file(tmp_path / "in" / "a.csv", rows)
    _csv_file(tmp_path / "in" / "b c.csv", rows[:5])
    df = splits.read_csv(spark, str(tmp_path / "in"), block_bytes=20_000)
    assert df.rdd.getNumPartitions() > 5
    got = [tuple(r[3:]) for r in df.orderBy("file", "start", "row").collect()]
    assert got == [tuple(r) for r in rows + rows[:5]]
    # rows come in the files' order without a sort
    assert [r[3] for r in df.collect()] == [r[0] for r in rows + rows[:5]]
    # Spark's one-task reader, but that it makes a quoted CRLF a newline
    whole = spark.read.options(**IO.PY_CSV_READ).csv(str(tmp_path / "in")).fillna("")
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(c.replace("\r\n", "\n") for c in r) for r in got)


def test_latin1_and_json_through_the_readers(spark, tmp_path):
    (tmp_path / "l").mkdir()
    rows = [[f"çé\nü{i}", "b", ""] for i in range(200)]
    _csv_file(tmp_path / "l" / "a.csv", rows, encoding="latin-1")
    got = IO.read_keyword_csv(spark, str(tmp_path / "l"), "ISO-8859-1", block_bytes=300).orderBy("seq").collect()
    assert [r.keyword for r in got] == [r[0] for r in rows]
    (tmp_path / "j").mkdir()
    items = [{"word": f'w"{i}\\'} for i in range(300)] + [{"other": 1}]
    (tmp_path / "j" / "w.json").write_text(json.dumps(items))
    words = IO.read_words_json(spark, str(tmp_path / "j"), block_bytes=500)
    assert sorted(r.word for r in words.collect()) == sorted(i["word"] for i in items[:-1])


def test_empty_files_and_short_rows(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.csv").write_text("words,b\r\n\r\nx\r\ny,1,2\r\n")
    (tmp_path / "e" / "empty.csv").write_text("")
    got = splits.read_csv(spark, str(tmp_path / "e"), block_bytes=4).orderBy("start", "row").collect()
    assert [tuple(r[3:]) for r in got] == [("x", None), ("y", "1")]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.json").write_text("[]")
    assert IO.read_words_json(spark, str(tmp_path / "n")).count() == 0
