"""Page store, visited set, keyword waves: what they read, and equality with plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from trawl.operators import crawl as C
from trawl.operators.crawl import crawl, crawl_in_sequence
from trawl.session import scratch_dir
from trawl.sources import manifest
from trawl.sources.pagestore import open_page_store, write_page_store
from trawl.sources.urlset import FANOUT, UrlSet


def graph(rng, n, missing=5):
    urls = [f"http://h/{i}" for i in range(n)]
    ghosts = [f"http://h/gone{i}" for i in range(missing)]
    return {u: rng.sample(urls + ghosts, rng.randint(0, 4)) for u in urls}


def page_rows(links):
    return [(u, v, [f"one two three four {u}"]) for u, v in links.items()]


def plain_crawl(links, seeds, visited, max_depth, budget):
    """One keyword: (url, depth, fetched), and what it fetched."""
    level, claimed, out, used = sorted(set(seeds)), set(), [], 0
    for depth in range(max_depth + 2):
        fetched = [u for u in level if u in links]
        if depth:
            fetched = fetched[:max(0, budget - used)]
        rows = [(u, depth, True) for u in fetched] + [(u, depth, False) for u in level if u not in links]
        used += len(fetched)
        out += rows
        claimed |= {u for u, _, _ in rows}
        level = sorted({v for u in fetched for v in links[u]} - claimed - visited)
    return out, {u for u, _, f in out if f}


def plain_sequence(links, seeds, visited, max_depth=3, budget=6):
    out, visited = [], set(visited)
    for seq, keyword in sorted({(s, k) for k, s, _ in seeds}):
        rows, got = plain_crawl(links, [u for k, s, u in seeds if (s, k) == (seq, keyword)], visited, max_depth, budget)
        out += [(keyword, seq, *r) for r in rows]
        visited |= got
    return sorted(out), visited


def files_read(df):
    """Files that the scans of a plan have read, after it ran."""
    df.collect()
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            plans.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            plans.append(p.plan())
            continue
        if "Scan parquet" in p.nodeName():
            total += p.metrics().apply("numFiles").value()
        kids = p.children()
        plans += [kids.apply(i) for i in range(kids.size())]
    return total


def test_fetch_reads_only_parts_that_hold_hits(spark):
    rows = page_rows({f"http://h/{i}": [] for i in range(400)})
    pages = spark.createDataFrame(rows, "url string, links array<string>, paragraphs array<string>")
    store = write_page_store(pages, bits=6)
    store = open_page_store(spark, store.path, 6)
    few = spark.createDataFrame([("http://h/7",), ("http://h/8",), ("http://h/none",)], "url string")
    hits = store.hits(few)
    assert files_read(hits) <= 3
    assert {r.url: r.fetched for r in hits.collect()} == {"http://h/7": True, "http://h/8": True, "http://h/none": False}
    got = store.fetch(hits.where("fetched"), ["paragraphs"])
    assert files_read(got) - files_read(store.hits(few)) <= 2
    assert sorted(r.paragraphs[0] for r in got.collect()) == ["one two three four http://h/7", "one two three four http://h/8"]
    everything = store.fetch(pages.select("url"), ["links"])
    assert everything.count() == 400


def test_store_and_table_give_the_same_crawl(spark):
    links = graph(random.Random(1), 60)
    pages = spark.createDataFrame(page_rows(links), "url string, links array<string>, paragraphs array<string>")
    seeds = spark.createDataFrame([("a", 1, "http://h/1"), ("b", 2, "http://h/2"), ("b", 2, "http://h/gone1")], "keyword string, seq long, url string")
    got = [sorted(map(tuple, crawl(spark, seeds, p, budget=9).reached.drop("lang").collect())) for p in (pages, write_page_store(pages, bits=3))]
    assert got[0] == got[1] and len(got[0]) > 10


@pytest.mark.parametrize("keywords,pages", [(500, 40000), (30, 30)])
def test_waves_equal_one_keyword_after_another(spark, monkeypatch, keywords, pages):
    """Few conflicts among many keywords; and many keywords on few pages."""
    rng = random.Random(keywords)
    links = graph(rng, pages)
    urls = list(links)
    seeds = [(f"k{rng.randrange(10**6)}", i // 2, rng.choice([*urls, "http://h/gone0"])) for i in range(keywords) for _ in range(rng.randint(1, 2))]
    old = rng.sample(urls, pages // 10)
    want, fetched = plain_sequence(links, seeds, old)
    store = write_page_store(spark.createDataFrame(page_rows(links), "url string, links array<string>, paragraphs array<string>"), bits=2)
    visited = UrlSet(spark, scratch_dir(spark, "seen"))
    visited.add(spark.createDataFrame([(u,) for u in old], "url string"), "r", 0)
    waves = []
    monkeypatch.setattr(C, "_walk", lambda *a, _w=C._walk: waves.append(1) or _w(*a))
    got = crawl_in_sequence(spark, spark.createDataFrame(seeds, "keyword string, seq long, url string"), store, visited=visited, budget=6)
    assert sorted((r.keyword, r.seq, r.url, r.depth, r.fetched) for r in got.reached.collect()) == want
    assert {r.url for r in got.visited.collect()} == fetched
    assert 1 < len(waves) <= 12  # chains of conflicts, not keywords
    print("walks", len(waves))


def test_visited_set_over_many_batches_and_a_stopped_merge(spark, monkeypatch):
    rng = random.Random(4)
    root = scratch_dir(spark, "lsm")
    seen, most = set(), 0
    for batch in range(20):
        urls = [f"http://h/{batch}/{i}" for i in range(30)] + rng.sample(sorted(seen), min(len(seen), 10)) + [None]
        df = spark.createDataFrame([(u,) for u in urls * 2], "url string")
        s = UrlSet(spark, root)
        if batch == 11:  # the merge that follows fails before it is published
            real = manifest.publish

            def once(spark, root, version, contents):
                if any(x["tier"] for x in contents["segments"] if x["id"] not in {y["id"] for y in s.segments()}):
                    raise RuntimeError("stopped")
                return real(spark, root, version, contents)

            with monkeypatch.context() as m:
                m.setattr(manifest, "publish", once)
                with pytest.raises(RuntimeError, match="stopped"):
                    s.add(df, "r", batch)
        s.add(df, "r", batch)  # after a stop, and whenever a batch is replayed, nothing is lost or doubled
        s.add(df, "r", batch)
        seen |= set(urls) - {None}
        most = max(most, len(s.segments()))
    got = [r.url for r in UrlSet(spark, root).urls().collect()]
    assert sorted(got) == sorted(seen)
    assert most < 2 * FANOUT and sum(x["rows"] for x in s.segments()) == len(seen)
    # a lookup reads only segments that may hold a hit
    ask = spark.createDataFrame([("http://h/19/3",), ("http://h/19/4",), ("http://nowhere",)], "url string")
    assert [r.url for r in s.without(ask).collect()] == ["http://nowhere"]
    assert len(s.last_read) < len(s.segments())
    fresh = spark.createDataFrame([(f"http://new/{i}",) for i in range(5)], "url string")
    assert s.without(fresh).count() == 5 and len(s.last_read) < len(s.segments())


def test_two_writers_of_one_version(spark):
    root = scratch_dir(spark, "manifest")
    assert manifest.read(spark, root) == (0, {})
    assert manifest.publish(spark, root, 0, {"a": 1}) == 1
    with pytest.raises(manifest.VersionTaken):
        manifest.publish(spark, root, 0, {"a": 2})
    assert manifest.read(spark, root) == (1, {"a": 1})


def test_large_budgets_are_picked_by_ranges(spark):
    """A hot keyword with a budget of half its rows; failed fetches are never cut."""
    from trawl.operators.crawl import ranked_per_group, top_per_group

    n = 40_000
    df = (spark.range(n).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("g"),
                                F.sha1(F.col("id").cast("string")).alias("u"), (F.col("id") % 11 == 0).alias("free"),
                                F.when(F.col("id") % 10 < 9, 18_000).otherwise(100).alias("k")))
    got = ranked_per_group(df, "g", ["u"], "k", exempt="free", ranges=16)
    assert got.columns == df.columns
    want = top_per_group(df, "g", ["u"], "k", exempt="free")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # no range holds more than an eighth of the rows
    parts = df.repartitionByRange(16, "g", "u").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert parts < n / 8


def test_a_crawl_with_a_large_budget_equals_the_salted_one(spark, monkeypatch):
    from trawl.operators import crawl as C

    pages = spark.createDataFrame([(f"u{i:03d}", [f"u{(i * 3 + j) % 200:03d}" for j in range(5)], ["p"]) for i in range(180)],
                                  "url string, links array<string>, paragraphs array<string>")
    seeds = spark.createDataFrame([("k", 1, "u000"), ("k", 1, "u001")], "keyword string, seq long, url string")
    rows = []
    for limit in (10_000, 0):
        monkeypatch.setattr(C, "SALTED_BUDGET", limit)
        rows.append(sorted(tuple(r) for r in C.crawl(spark, seeds, pages, budget=30).reached.select("url", "depth", "fetched").collect()))
    assert rows[0] == rows[1] and sum(r[2] for r in rows[0]) == 30
