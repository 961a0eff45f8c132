"""The pipeline: every stage against a plain version of its rule on its own input."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from test_decontaminate import slow as slow_windows
from test_line_dedup import brute as slow_lines
from test_simhash_anchor import slow_components, slow_simhash
from trawl.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "mixing to target weights"]

    calm = P.toxicity(spark, docs, SF)
    assert calm.columns == docs.columns
    scores = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    calm = calm.toPandas()
    assert set(calm.doc_id) == {d for d, s in scores.items() if s < 0.5}

    frame = spark.createDataFrame(calm, docs.schema)
    out = P.line_dedup(spark, frame, SF)
    assert out.columns == docs.columns
    lined = out.toPandas()
    want = {d: t for d, t in slow_lines(list(zip(calm.doc_id, calm.text)))}
    before = dict(zip(calm.doc_id, calm.text))
    assert dict(zip(lined.doc_id, lined.text)) == {d: t for d, t in want.items() if t.strip() or t == before[d]}
    assert (lined.text.str.len() == lined.n_chars).all()

    frame = spark.createDataFrame(lined, docs.schema)
    out = P.simhash_near_dedup(spark, frame, SF)
    assert out.columns == docs.columns
    single = out.toPandas()
    comp = slow_components(list(lined.doc_id), [slow_simhash(t) for t in lined.text], 4)
    assert set(single.doc_id) == {d for d, c in comp.items() if d == c} and len(single) == single.doc_id.nunique()

    frame = spark.createDataFrame(single, docs.schema)
    out = P.decontamination(spark, frame, SF)
    assert out.columns == docs.columns
    clean = out.toPandas()
    hits = slow_windows(list(single.text), [(r.item_id, r.text) for r in bench.collect()])
    assert set(clean.doc_id) == {d for d, h in zip(single.doc_id, hits) if not h[1]}

    frame = spark.createDataFrame(clean, docs.schema)
    out = P.mixing_to_targets(spark, frame, SF)
    assert out.columns == [*docs.columns, "rate"]
    mixed = out.toPandas()
    assert set(mixed.doc_id) <= set(clean.doc_id) and (mixed.rate > 0).all()


def test_run_is_the_chain_and_takes_odd_rows(spark, tmp_path):
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, None, "en", "s", None), (900003, "x " * 50000, "en", "s", 100000),
                                 (900003, "x " * 50000, "en", "s", 100000)], docs.schema)
    docs.unionByName(odd).withColumn("mix", F.lit(1)).withColumn("Rate", F.lit("r")).write.parquet(f"{sf}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    got = P.run(spark, sf)
    assert got.columns == [*docs.columns, "mix", "Rate", "rate_"]
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(900003) == 1 and len(ids) > 100
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{sf}/empty/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{sf}/empty/{t}.parquet")
    assert P.run(spark, f"{sf}/empty").count() == 0
