"""Keyword and seed operators: clean, pop in order, threshold, seed requests, stale skip.

The reference keeps keywords in a CSV consumed from the top and seed URLs in per-keyword
queues. Here both are tables with an explicit order column: ``keywords(seq, keyword)`` and
``seeds(keyword, pos, url)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ws import WS_CHARS

# Fixed value: minimum seeds a keyword needs before it is crawled.
MIN_SEEDS = 10


def clean_keywords(df: DataFrame, col: str = "keyword") -> DataFrame:
    """To string, strip Python whitespace; empty (or NULL) means no keyword."""
    k = F.trim(F.col(col).cast("string"), F.lit(WS_CHARS))
    return df.withColumn(col, k).where(F.col(col) != "")


def order_key(df: DataFrame, col: str = "seq") -> F.Column:
    """The queue order of ``df``: a struct (file, row) as it is, a number as a long."""
    if df.schema[col].dataType.typeName() == "struct":
        return F.col(col)
    return F.col(col).cast("long").alias(col)


def pop_keywords(keywords: DataFrame, n: int = 1, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """O2/K2: the first ``n`` keywords in ``order`` (unique) and the remainder.

    The head is a top-``n`` (per-partition top-n, then a merge of n × partitions rows), the
    remainder an anti-join against those ``n`` rows (broadcast: its size is ``n``).
    Write the remainder to a new path; never overwrite the table being read.
    """
    head = keywords.orderBy(order).limit(n)
    rest = keywords.join(F.broadcast(head.select(order)), order, "left_anti")
    return head, rest


def pop_keyword_file(spark, path: str, rest_path: str, n: int = 1) -> DataFrame:
    """O2/O3/K2 on keyword CSV files: the first ``n`` keywords in file order; the rest is written
    to a new path, in order, and can be popped from there again."""
    from ..sources.files import PY_CSV_WRITE, read_keyword_csv

    head, rest = pop_keywords(clean_keywords(read_keyword_csv(spark, path)), n)
    ordered = rest.repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.select(F.col("keyword").alias("words")).write.options(**PY_CSV_WRITE).csv(rest_path)
    return head


def seed_counts(seeds: DataFrame) -> DataFrame:
    """A1 helper: seeds per keyword, duplicates counted."""
    return seeds.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_seeds"))


def keywords_with_seeds(seeds: DataFrame, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """A1: keywords that have at least ``min_seeds`` seeds (a failing keyword loses its seeds)."""
    return seed_counts(seeds).where(F.col("n_seeds") >= min_seeds)


def seed_requests(keywords: DataFrame, seeds: DataFrame, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """S9 + J2 + A1 + X3: depth-0 requests ``(keyword, seq, pos, url, depth)`` for keywords
    with enough seeds; seeds keep their queue position ``pos``."""
    ok = keywords_with_seeds(seeds, min_seeds).select("keyword")
    return (keywords.select("keyword", "seq").join(ok, "keyword")
            .join(seeds.select("keyword", "pos", "url"), "keyword")
            .withColumn("depth", F.lit(0)))


def drop_stale(responses: DataFrame, active: DataFrame, col: str = "keyword") -> DataFrame:
    """Keep responses whose keyword is an active one (left semi-join)."""
    return responses.join(active.select(col).distinct(), col, "left_semi")
