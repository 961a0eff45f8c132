"""Structured Streaming wrappers: keyword intake, cross-run URL dedup, crawl per micro-batch.

The reference loops forever: a producer pops keywords and pushes seed URLs, a consumer
restarts the crawler per keyword, and a shared visited set persists between runs. Here each
loop is a streaming query over a file source. Its checkpoint is durable: a parameter, by default
a folder under the output root, so a restarted query goes on where it stopped (a checkpoint belongs
to one source folder; another source on the same root needs one of its own). Every sink is a
table written by ``foreachBatch`` into a folder keyed by the checkpoint and the batch id
(overwritten on retry, so a replayed batch is idempotent, and another checkpoint on the same root
never touches it). State that must outlive a run (the visited set) is a log-structured set
(``sources.urlset``), asked per batch, instead of an unbounded in-memory state store.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keywords import clean_keywords, order_key
from ..sources.urlset import UrlSet

CHECKPOINTS = "_checkpoints"


def _run_id(checkpoint: str) -> str:
    return "r" + hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def _batch_path(root: str, run: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/run={run}/batch={batch_id}"


def _start(stream: DataFrame, per_batch, checkpoint: str, once: bool, processing_time: str, drain: bool = False):
    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if drain:  # batch after batch until the source has no more rows
        q = w.trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return q
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=processing_time)
    q = w.start()
    if once:
        q.awaitTermination()
    return q


def keyword_stream(spark: SparkSession, path: str, schema: str = "seq long, keyword string",
                   files_per_trigger: int | None = None) -> DataFrame:
    """Keywords with their queue order, arriving as Parquet files in ``path`` (one or more per
    drop). Keyword CSV files are a queue of rows: ``sources.rowqueue.keyword_queue``."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def run_intake(spark: SparkSession, keywords: DataFrame, seeds_for: DataFrame | None, out_root: str,
               trigger_once: bool = True, processing_time: str = "1 second", checkpoint: str | None = None,
               drain: bool = False):
    """I2 + K6: each micro-batch of keywords is cleaned and appended with its seed URLs.

    ``seeds_for(keyword, pos, url)`` is the result-page lookup (stored); a keyword without
    seeds is still enqueued (the threshold is applied when crawling). ``None``: there are no seeds, and
    a batch is one pass over its rows, without the lookup's shuffles. A batch is one write (one
    commit) of both kinds of rows; ``read_intake`` gives them back. ``drain`` takes batch after batch
    until the source is empty, then stops.
    """
    checkpoint = checkpoint or f"{out_root.rstrip('/')}/{CHECKPOINTS}/intake"
    run = _run_id(checkpoint)
    # a small batch costs as much to plan as to run, so what all batches share is made once
    no_seed = [F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("url")] if seeds_for is None else []
    as_keywords = [F.col("keyword"), order_key(keywords), F.lit("keywords").alias("kind"), *no_seed]
    lookup = None if seeds_for is None else seeds_for.select("keyword", "pos", "url", F.lit("seeds").alias("kind"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        kw = clean_keywords(batch)
        if lookup is not None:
            kw = kw.persist()  # used twice; the source is read (and its rows counted) once
        rows = kw.select(*as_keywords)
        if lookup is not None:
            rows = rows.unionByName(lookup.join(kw.select("keyword"), "keyword", "left_semi"), allowMissingColumns=True)
        rows.write.mode("overwrite").partitionBy("kind").parquet(_batch_path(f"{out_root}/intake", run, batch_id))
        if lookup is not None:
            kw.unpersist()

    return _start(keywords, per_batch, checkpoint, trigger_once, processing_time, drain)


def read_intake(spark: SparkSession, out_root: str, kind: str) -> DataFrame:
    """The enqueued ``keywords(keyword, seq)`` or ``seeds(keyword, pos, url)``."""
    cols = ["keyword", "seq"] if kind == "keywords" else ["keyword", "pos", "url"]
    return spark.read.parquet(f"{out_root}/intake").where(F.col("kind") == kind).select(*cols)


def run_visited_dedup(spark: SparkSession, urls: DataFrame, visited_root: str, trigger_once: bool = True,
                      processing_time: str = "1 second", checkpoint: str | None = None):
    """Append only URLs never seen before to the visited set under ``visited_root``
    (``sources.urlset.UrlSet``: read it with ``.urls()``).

    A batch asks the segments' filters and reads only segments that may hold one of its URLs; it
    becomes a segment of its own, and full tiers are merged as the stream goes. The state is the set
    itself, so it survives restarts and grows on shared storage, not in memory; a batch that is replayed
    after it was published adds nothing.
    """
    checkpoint = checkpoint or f"{visited_root.rstrip('/')}{CHECKPOINTS}"
    run = _run_id(checkpoint)
    visited = UrlSet(spark, visited_root)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        visited.add(batch, run, batch_id)

    return _start(urls, per_batch, checkpoint, trigger_once, processing_time)


def run_crawl_stream(spark: SparkSession, keywords: DataFrame, seeds: DataFrame, pages_info: DataFrame,
                     out_root: str, crawl_kwargs: dict | None = None, trigger_once: bool = True,
                     processing_time: str = "1 second", checkpoint: str | None = None, drain: bool = False):
    """Per micro-batch, one crawl after another for its keywords by ``seq``
    (``maxFilesPerTrigger`` = 1, or a ``keyword_queue`` of one row a batch with ``drain``, gives the
    reference's one keyword per run); the visited set
    (``sources.urlset.UrlSet``) carries over between batches and restarts. Writes
    ``out_root/corpus`` and ``out_root/visited``."""
    from ..operators.crawl import crawl_in_sequence

    checkpoint = checkpoint or f"{out_root.rstrip('/')}/{CHECKPOINTS}/crawl"
    run = _run_id(checkpoint)
    corpus_root, visited = f"{out_root}/corpus", UrlSet(spark, f"{out_root}/visited")
    kwargs = dict(crawl_kwargs or {})

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        kw = clean_keywords(batch).select("keyword", "seq")
        if kw.isEmpty():
            return
        if visited.has(run, batch_id):
            return  # a replay: the corpus was written before the set
        s = seeds.select("keyword", "url").join(kw, "keyword").select("keyword", "seq", "url")
        res = crawl_in_sequence(spark, s, pages_info, visited=visited, **kwargs)
        # the corpus first: a batch that fails between the two is replayed with the same visited set
        res.corpus.write.mode("overwrite").parquet(_batch_path(corpus_root, run, batch_id))
        visited.add(res.reached.where("fetched"), run, batch_id)

    return _start(keywords, per_batch, checkpoint, trigger_once, processing_time, drain)


def batch_counters(spark: SparkSession, query) -> DataFrame:
    """A6/F15 for a stream: a row per batch of ``query`` with its rows and elapsed seconds, from the
    progress that Spark keeps (``spark.sql.streaming.numRecentProgressUpdates``, 100 by default)."""
    rows = [(p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0) / 1000) for p in query.recentProgress
            if "addBatch" in p["durationMs"]]
    return spark.createDataFrame(rows, "batch long, rows long, seconds double")
