"""Keyword cleaning, popping in order, seed threshold and stale-keyword skip."""

from pyspark.sql import functions as F

from trawl.operators.keywords import (clean_keywords, drop_stale, keywords_with_seeds, pop_keywords,
                                      seed_requests)


def test_clean_keywords(spark):
    rows = [(1, "  elma "), (2, "armut\t\xa0"), (3, ""), (4, " 　 "), (5, "null"), (6, "007"), (7, None),
            (8, "çilek ")]
    df = spark.createDataFrame(rows, "seq long, keyword string")
    got = sorted((r.seq, r.keyword) for r in clean_keywords(df).collect())
    assert got == [(1, "elma"), (2, "armut"), (5, "null"), (6, "007"), (8, "çilek")]


def test_pop_in_order(spark):
    df = spark.createDataFrame([(s, f"k{s}") for s in (5, 3, 9, 1, 7)], "seq long, keyword string")
    head, rest = pop_keywords(df, 2)
    assert [r.keyword for r in head.orderBy("seq").collect()] == ["k1", "k3"]
    assert sorted(r.keyword for r in rest.collect()) == ["k5", "k7", "k9"]


def test_threshold_requests_and_stale(spark):
    seeds = spark.createDataFrame(
        [("a", i, f"http://h/a{i % 4}") for i in range(10)] + [("b", i, f"http://h/b{i}") for i in range(9)],
        "keyword string, pos long, url string")
    kws = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "keyword string, seq long")
    assert [(r.keyword, r.n_seeds) for r in keywords_with_seeds(seeds).collect()] == [("a", 10)]  # duplicates count
    req = seed_requests(kws, seeds).collect()
    assert len(req) == 10 and {r.keyword for r in req} == {"a"} and {r.depth for r in req} == {0}
    resp = spark.createDataFrame([("a", "http://h/a0"), ("b", "http://h/b0")], "keyword string, url string")
    assert [r.keyword for r in drop_stale(resp, keywords_with_seeds(seeds)).collect()] == ["a"]


def test_language_model_is_whole_and_right_on_unseen_texts(spark, tmp_path):
    """Turkish, too; and no feature cut: a gram seen once still counts."""
    from trawl.operators import langid as LID

    words = {"tr": "ve bir bu için çok güzel değil şehir kırmızı ağaç öğretmen yağmur ışık üzüm çocuk".split(),
             "en": "and the this for very nice not city red tree teacher rain light grape child".split(),
             "de": "und ein dies für sehr schön nicht stadt rot baum lehrer regen licht traube kind".split()}
    import random

    rnd = random.Random(1)
    make = lambda lg: " ".join(rnd.choices(words[lg], k=8))
    train = spark.createDataFrame([(make(lg), lg) for lg in words for _ in range(60)] + [("qxjq", "de"), (None, "tr")], "text string, lang string")
    path = str(tmp_path / "model-1")
    LID.save(LID.train(train), path)
    model = LID.load(spark, path)
    held = [(i, make(lg), lg) for i, lg in enumerate(list(words) * 30)] + [(1000, "qxjq", "de"), (1001, "", None), (1002, None, None)]
    got = {r.i: r.p for r in LID.classify(spark.createDataFrame([h[:2] for h in held], "i int, t string"), model, "t", "i", "p").collect()}
    assert len(got) == len(held)
    assert all(got[i] == lg for i, _, lg in held if lg)


def test_language_model_of_many_grams(spark):
    """Far more grams than a fixed broadcast bound would hold for small tests: no bound, no raise."""
    from trawl.operators import langid as LID

    docs = spark.range(0, 3000, numPartitions=4).select(F.sha2(F.col("id").cast("string"), 512).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    model = LID.train(docs)
    assert model.wide.count() >= 4000
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = LID.classify(docs.withColumn("k", F.xxhash64("text")), model, "text", "k").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == 3000


def test_broadcast_and_joined_models_agree(spark):
    """Labels and probabilities within the broadcast bound and beyond it; ties, empty and null texts."""
    from trawl.operators import langid as LID

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = LID.train(docs.select("text", "lang"))
    odd = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, " \n"), (10**9 + 3, "ΣΑΣ İx 😀a"), (10**9 + 4, "zqx")], "doc_id long, text string")
    some = docs.select("doc_id", "text").union(odd)
    one, other = ({r.doc_id: (r.pred_lang, round(r.score, 9)) for r in LID.classify(some, model, "text", "doc_id", broadcast_bytes=b).collect()}
                  for b in (1 << 30, 0))
    assert one == other and len(one) == some.count()
    assert all(0 < p <= 1 for _, p in one.values())


def test_language_scoring_has_no_exchange(spark):
    from trawl.operators import langid as LID

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = LID.train(docs.select("text", "lang"))
    plan = LID.classify(docs, model, "text", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
