"""Page operators: one HTML pass, then native paragraph and link work.

``analyze_pages`` is the only step that touches ``html``; everything after it works on
small columns (paragraph arrays, link arrays), so a crawl or corpus job never re-reads or
re-parses a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_paragraphs
from .html import parse_pages


#: Session setting: the default of ``partitions`` in ``analyze_pages``.
PARTITIONS_KEY = "spark.trawl.htmlPartitions"


def analyze_pages(pages: DataFrame, keys: list[str] | None = None, separator: str = "",
                  min_words: int = 3, partitions: int | None = None) -> DataFrame:
    """``pages(…, url, html)`` → ``(keys…, url, blocks, hrefs, links, parse_error, paragraphs)``.

    The pages stay in the scan's own splits (no shuffle of ``html``); their number is the
    session's ``spark.sql.files.maxPartitionBytes`` / ``minPartitionNum``. A store of few, large row
    groups can't be split by the scan: ``partitions`` (or the session's ``spark.trawl.htmlPartitions``)
    deals its pages by ``url`` to so many tasks before they are parsed. Only ``keys + url + html`` enter
    the Python stage; filter ``pages`` before calling so the scan prunes. ``paragraphs`` is the cleaned list (drop-empty, dedup, > ``min_words`` words,
    whitespace collapsed), in document order.
    """
    keys = [k for k in (keys or []) if k != "url"]
    pages = pages.select(*keys, "url", "html")
    partitions = partitions or int(pages.sparkSession.conf.get(PARTITIONS_KEY, "0"))
    if partitions:
        pages = pages.repartition(partitions, "url")
    parsed = parse_pages(pages, separator=separator)
    return parsed.withColumn("paragraphs", clean_paragraphs("blocks", min_words))


def parse_error_counts(analyzed: DataFrame, group: list[str]) -> DataFrame:
    """Pages, and pages whose markup the parser rejected, per group."""
    return analyzed.groupBy(*group).agg(F.count(F.lit(1)).alias("pages"),
                                        F.count(F.when(F.col("parse_error"), 1)).alias("rejected"))


def paragraph_rows(analyzed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per kept paragraph, ``para_idx`` = 0-based position in the page's list."""
    keys = list(keys or [])
    return analyzed.select(*keys, "url", F.posexplode("paragraphs").alias("para_idx", "text"))


def page_text(analyzed: DataFrame) -> DataFrame:
    """the page's paragraphs joined by one space (what the language step reads)."""
    return analyzed.withColumn("page_text", F.array_join("paragraphs", " "))


def resolved_links(analyzed: DataFrame, keys: list[str] | None = None, strip_fragment: bool = False) -> DataFrame:
    """Distinct resolved links per page → ``(keys…, src_url, dst_url)``.

    ``#frag`` links are distinct URLs by default, as in the reference. ``strip_fragment``
    drops fragments before the per-page dedup; stored page URLs must then be normalised
    the same way (``strip_url_fragment``) or fetches will miss.
    """
    keys = list(keys or [])
    links = F.col("links")
    if strip_fragment:
        links = F.transform(links, lambda u: strip_url_fragment(u))
    return analyzed.select(*keys, F.col("url").alias("src_url"),
                           F.explode(F.array_distinct(links)).alias("dst_url"))


def strip_url_fragment(url) -> F.Column:
    """The URL without its ``#fragment``."""
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_replace(c, "#.*$", "")


def clean_links(links: DataFrame, col: str = "dst_url") -> DataFrame:
    """Drop links starting ``javascript`` (case-sensitive, after resolution) or blank."""
    return links.where(followable(col))


def followable(col: str = "url") -> F.Column:
    """P6 as a condition: not ``javascript…`` (case-sensitive) and not blank."""
    c = F.col(col)
    return ~c.startswith("javascript") & (F.trim(c) != "")
