"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion with a ``noop`` write (every row produced, nothing brought
to the driver). The crawl query also reports pages/s and characters/s, the reference's only
run-time figures.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "crawl_bfs",
    "page_paragraphs",
    "links_resolved",
    "lang_classify",
    "lang_gate",
    "redirect_decode",
    "serp_links",
    "corpus_shards",
    "corpus_stats",
    "crawl_budget",
    "visited_from_lines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from pyspark.sql import functions as F

    from trawl.plans import queries as Q
    from trawl.session import ensure_checkpoint_dir, local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    ensure_checkpoint_dir(spark)
    # the given tables are one row group each, which one task would take alone
    for setting in ("spark.trawl.htmlPartitions", "spark.trawl.textPartitions"):
        spark.conf.set(setting, str(spark.sparkContext.defaultParallelism))
    # Generic warm-up (not timed per query, reported as warmup_s): starts the Python worker
    # pool and JIT-compiles the common paths, so the first query does not also pay for the
    # process start-up.
    tw = time.time()
    (spark.range(0, 20000, numPartitions=int(cpus) if cpus.isdigit() else 8)
     .mapInPandas(lambda it: (p for p in it), "id long")
     .groupBy((F.col("id") % 7).alias("k")).count().collect())
    warmup_s = round(time.time() - tw, 3)
    times: dict[str, float] = {}
    extra: dict[str, float] = {"warmup_s": warmup_s}
    for name in names:
        t0 = time.time()
        df = Q.QUERIES[name](spark, sf_dir)
        if name == "crawl_bfs":
            df = df.cache()
            stats = df.agg(F.count_distinct("url").alias("pages"), F.sum(F.char_length("text")).alias("chars")).first()
            dt = time.time() - t0
            extra["crawl_pages"] = int(stats["pages"] or 0)
            extra["crawl_chars"] = int(stats["chars"] or 0)
            extra["crawl_pages_per_s"] = round(extra["crawl_pages"] / dt, 2)
            extra["crawl_chars_per_s"] = round(extra["crawl_chars"] / dt, 1)
            df.unpersist()
        else:
            df.write.format("noop").mode("overwrite").save()
            dt = time.time() - t0
        times[name] = round(dt, 3)
        print(f"# {name}: {dt:.2f}s", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cpus": cpus}
    out.update(extra)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
