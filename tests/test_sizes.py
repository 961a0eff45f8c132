"""What a task or a write makes stays bounded: pieces of batches, files of shards, tasks of small files."""

import glob

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T

from trawl.functions.batches import pieces
from trawl.operators import langid as LID
from trawl.operators.corpus import assign_shards
from trawl.sources import files as IO
from trawl.sources import splits
from trawl.sources.corpustable import CorpusTable


def test_pieces_are_bounded_and_whole():
    texts = ["ab" * 30, None, "", "é" * 50, "x" * 500, "y", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], ["i", "t"])
    got = list(pieces([batch, batch.slice(0, 0), batch.slice(2)], 1, limit=100))
    assert [i for b in got for i in b.column(0).to_pylist()] == [*range(7), *range(2, 7)]
    for b in got:
        assert b.num_rows == 1 or sum(len(t.encode()) for t in b.column(1).to_pylist() if t) <= 100


def test_pages_are_parsed_a_piece_at_a_time(monkeypatch):
    from trawl.operators import html as H

    class Pages:
        sparkSession = None
        schema = T.StructType().add("page_id", "long").add("url", "string").add("html", "string")

        def mapInPandas(self, run, schema):
            return run

    monkeypatch.setattr(H, "ship_package", lambda spark: None)
    html = "<p>" + "word " * 1000 + "</p><a href='/x'>"
    pages = pd.DataFrame({"page_id": range(1000), "url": "http://h/", "html": [html] * 999 + [None]})
    got = list(H.parse_pages(Pages())(iter([pages])))
    assert max(len(x) for x in got) <= (1 << 20) // len(html) + 1  # a page without html takes no room
    assert [i for x in got for i in x["page_id"]] == [*range(1000)]
    assert got[0]["links"].iloc[0] == ["http://h/x"] and got[-1]["blocks"].iloc[-1] == []


def _watched(monkeypatch):
    seen, keys = [], LID._gram_keys

    def watched(texts):
        seen.append(sum(len(t or "") for t in texts.to_pylist()))
        return keys(texts)

    monkeypatch.setattr(LID, "_gram_keys", watched)
    return seen


def test_training_counts_a_piece_at_a_time(monkeypatch):
    texts = [f" wort{i % 7} und noch {'lang ' * 400}" for i in range(3000)]
    langs = ["de" if i % 3 else "nl" for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], ["lang", "s"])
    seen = _watched(monkeypatch)
    rows = [r for b in LID._gram_counts(iter([batch, batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert max(seen) <= 1 << 20 and sum(seen) == 2 * sum(map(len, texts))
    assert len({r[:2] for r in rows}) == len(rows)  # a row a language and gram, over all pieces
    want = {}
    for t, lang in zip(texts, langs):
        for i in range(1, len(t) - 1):
            if t[i] != " ":
                want[lang, t[i - 1:i + 2]] = want.get((lang, t[i - 1:i + 2]), 0) + 2
    assert {r[:2]: r[2] for r in rows} == want


def test_full_languages_are_handed_on(monkeypatch):
    monkeypatch.setattr(LID, "HELD_GRAMS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["de"] * 3), pa.array([" abcdefghijklmnop ", " qrst ", " abc "])], ["lang", "s"])
    rows = [r for b in LID._gram_counts(iter([batch, batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sum(r[2] for r in rows) == 2 * 23 and sum(r[2] for r in rows if r[1] == "abc") == 4


def test_scoring_takes_a_piece_at_a_time(spark, monkeypatch):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string")
    model = LID.train(train)
    rows = [(i, ("the dog " if i % 2 else "die katze ") * 100) for i in range(2600)]
    want = {r.i: r.pred_lang for r in LID.classify(spark.createDataFrame(rows, "i long, t string"), model, "t", "i").collect()}
    assert want == {i: "en" if i % 2 else "de" for i in range(2600)}
    wide = model.wide.toArrow()
    grams = np.frombuffer("".join(wide.column(0).to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, 3)
    keys = (grams[:, 0] << 42) | (grams[:, 1] << 21) | grams[:, 2]
    order = np.argsort(keys)
    weight = np.stack([wide.column(i + 1).to_numpy() for i in range(2)], axis=1)[order]

    class Sent:
        value = (keys[order], weight, [model.priors[v] for v in model.langs], [model.defaults[v] for v in model.langs], model.langs)

    seen = _watched(monkeypatch)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([f" {r[1]}" for r in rows])], ["i", "t"])
    got = {i: v for b in LID._scores(Sent, "i", "pred_lang", "score")(iter([batch])) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert got == want and max(seen) <= 1 << 20 and len(seen) > 1


def _rows(spark, n):
    return spark.range(n).selectExpr("id i", "'k' keyword", "concat('http://h/', id) url", "repeat('word ', 20) text")


def test_a_shard_is_one_file(spark, tmp_path):
    out = assign_shards(_rows(spark, 2000), ["i"], limit_bytes=4000)
    IO.write_corpus_shards(IO.by_shard(out, ["i"]), f"{tmp_path}/c")
    back = IO.read_corpus(spark, f"{tmp_path}/c")
    shards = back.select("shard").distinct().count()
    assert shards > 50 and len(glob.glob(f"{tmp_path}/c/shard=*/*.csv")) == shards
    assert back.count() == 2000


def test_an_append_writes_a_shard_as_one_file(spark, tmp_path):
    corpus = CorpusTable(spark, f"{tmp_path}/c", 4000)
    corpus.append(_rows(spark, 2000), ["i"])
    shards = corpus.rows().select("shard").distinct().count()
    assert shards > 50 and len(glob.glob(f"{tmp_path}/c/data/append=*/shard=*/*.csv")) == shards
    assert corpus.state()[0] == corpus.rows().agg({"shard": "max"}).first()[0]


def test_adoption_passes_over_files_without_rows(spark, tmp_path):
    for name, body in (("2", "keyword,url,text\r\nk,u,t\r\n"), ("10", "keyword,url,text\r\nk,u,tt\r\n"), ("11", "keyword,url,text\r\n")):
        (tmp_path / f"corpus_{name}.csv").write_text(body, newline="")
    assert CorpusTable(spark, f"{tmp_path}/t", 1000).adopt(str(tmp_path)) == (10, 8)


def test_small_files_share_tasks(spark, tmp_path):
    for n in range(60):
        (tmp_path / f"f{n}.csv").write_text("a\r\n" + f"{n}\r\n" * 3, newline="")
    df = splits.read_csv(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() < 5
    assert sorted(int(r.a) for r in df.collect()) == sorted([*range(60)] * 3)
    (tmp_path / "large").mkdir()
    (tmp_path / "large" / "f.csv").write_text("a\r\n" + "x\r\n" * 1000, newline="")
    assert splits.read_csv(spark, f"{tmp_path}/large", block_bytes=512).rdd.getNumPartitions() == 6


def test_para_normalize_counts_no_words(spark, tmp_path):
    from trawl.plans.queries import QUERIES

    html = "<article><p>a  b\tc d</p><p>x y z</p><p>　one  two three four </p></article>"
    spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = QUERIES["para_normalize"](spark, str(tmp_path))
    got = {r.para_idx: (r.raw_chars, r.n_chars, r.raw_ws) for r in out.collect()}
    assert got[1] == (8, 7, 4) and got[2] == (19, 18, 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # one string per word of every block
