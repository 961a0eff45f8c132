"""Stored pages, clustered by ranges of a URL hash, so that a fetch reads what it asks for.

The store is a parquet table partitioned by ``part``, the top bits of the URL's hash. Requests
know their part themselves: a lookup lists the parts it needs (at most as many numbers as the store has
parts) and reads only those, first the ``url`` column to find hits, then the wide columns of the
parts that hold any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

# Input bytes that one part should hold.
PART_BYTES = 128 << 20


def bits_for(n_bytes: int, at_least: int = 4) -> int:
    """Hash bits for a store of about ``n_bytes``: 2^bits parts of some ``PART_BYTES``."""
    return max(at_least, (-(-n_bytes // PART_BYTES) - 1).bit_length())


class PageStore:
    """``pages(url, links, paragraphs, ...)`` (unique on ``url``) under ``path``, in 2^``bits`` parts."""

    def __init__(self, spark: SparkSession, path: str, bits: int):
        self.spark, self.path, self.bits = spark, path, bits
        self.schema = None

    def part(self, url: str = "url") -> F.Column:
        if not self.bits:
            return F.lit(0)
        return F.shiftrightunsigned(F.xxhash64(url), 64 - self.bits).cast("int")

    def table(self) -> DataFrame:
        if self.schema is None:
            self.schema = self.spark.read.parquet(self.path).schema
        return self.spark.read.schema(self.schema).parquet(self.path)

    def parts_of(self, rows: DataFrame) -> list[int]:
        """The parts that any of ``rows`` (a written or cheap table) lies in."""
        return [r[0] for r in rows.select(self.part().alias("part")).distinct().collect()]

    def hits(self, requests: DataFrame, parts: list[int] | None = None) -> DataFrame:
        """``requests`` with ``fetched``: whether their ``url`` is stored (J3). ``parts``: theirs, if
        known."""
        parts = self.parts_of(requests) if parts is None else parts
        stored = self.table().where(F.col("part").isin(parts)).select("url", F.lit(True).alias("__hit"))
        return requests.join(stored, "url", "left").withColumn("fetched", F.coalesce("__hit", F.lit(False))).drop("__hit")

    def fetch(self, found: DataFrame, columns: list[str], parts: list[int] | None = None) -> DataFrame:
        """``found`` (its ``url`` stored) with the wide columns, from the parts it lies in."""
        parts = self.parts_of(found) if parts is None else parts
        return found.join(self.table().where(F.col("part").isin(parts)).select("url", *columns), "url")


class TablePages:
    """The same questions to a plain table of pages (joins read its columns whole)."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def parts_of(self, rows: DataFrame) -> list[int]:
        """One part, or none without rows."""
        return [] if rows.isEmpty() else [0]

    def hits(self, requests: DataFrame, parts: list[int] | None = None) -> DataFrame:
        stored = self.pages.select("url", F.lit(True).alias("__hit"))
        return requests.join(stored, "url", "left").withColumn("fetched", F.coalesce("__hit", F.lit(False))).drop("__hit")

    def fetch(self, found: DataFrame, columns: list[str], parts: list[int] | None = None) -> DataFrame:
        return found.join(self.pages.select("url", *columns), "url")


def write_page_store(pages: DataFrame, bits: int = 8, path: str | None = None) -> PageStore:
    """Write ``pages(url, ...)`` once, one file a part, sorted by ``url``; under the checkpoint root by
    default."""
    spark = pages.sparkSession
    store = PageStore(spark, path or scratch_dir(spark, "page-store"), bits)
    (pages.withColumn("part", store.part()).repartition(1 << bits, "part").sortWithinPartitions("part", "url")
     .write.partitionBy("part").parquet(store.path))
    return store


def open_page_store(spark: SparkSession, path: str, bits: int) -> PageStore:
    """A store that ``write_page_store`` wrote."""
    return PageStore(spark, path, bits)


def as_pages(pages: DataFrame | PageStore | TablePages) -> PageStore | TablePages:
    return TablePages(pages) if isinstance(pages, DataFrame) else pages

