"""A growing set of URLs as a log-structured table: sorted segments, a Bloom filter each.

New URLs become a segment; ``FANOUT`` segments of a tier are merged into one of the next, so
their number grows with the logarithm of the set. A segment's filter is a table of blocks of ``BLOCK``
bits: a URL belongs to one block and sets ``BITS`` of its bits, so asking is one join row a URL
and segment. A lookup asks the filters first and then reads only the segments that may hold a hit.

What is live is a manifest (``sources.manifest``). A batch that was published is known by its run and
number and isn't added again; parts of a writer that failed before it published are never
read, and a merge that failed half-way leaves the set as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest

#: Segments of a tier before they are merged.
FANOUT = 4
#: Bits of a filter block (a bitmap of Spark's), bits a URL, bits that it sets.
BLOCK = 32768
BITS_A_URL = 10
BITS = 4


def _block(url, blocks) -> F.Column:
    return F.pmod(F.xxhash64(url), blocks)


def _bit(url, i: int) -> F.Column:
    """Place of the URL's bit ``i`` in its block."""
    return F.shiftrightunsigned(F.xxhash64(url, F.lit("bits")), 15 * i).bitwiseAND(F.lit(BLOCK - 1))


def _is_set(bits: str, place: F.Column) -> F.Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2.0), F.pmod(place, F.lit(8))).cast("int")) != 0


class UrlSet:
    """The set under ``root`` (``url``, never null, each once)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        #: Segments that the last lookup read.
        self.last_read: list[str] = []

    def _state(self) -> tuple[int, dict]:
        version, state = manifest.read(self.spark, self.root)
        return version, state or {"segments": [], "batches": {}}

    def segments(self) -> list[dict]:
        """Live segments: ``id``, ``tier``, ``rows``, ``blocks``."""
        return self._state()[1]["segments"]

    def has(self, run: str, batch: int) -> bool:
        """Whether this batch was added."""
        return self._state()[1]["batches"].get(run, -1) >= batch

    def _read(self, ids: list[str]) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], "url string")
        return self.spark.read.schema("url string").parquet(*[f"{self.root}/segments/{i}" for i in ids])

    def urls(self) -> DataFrame:
        return self._read([s["id"] for s in self.segments()])

    def without(self, df: DataFrame, col: str = "url") -> DataFrame:
        """Rows of ``df`` whose ``col`` isn't in the set. The filters are asked and the segments to read
        are settled at once; ``df`` should be written or cheap."""
        live = self.segments()
        self.last_read = []
        if not live:
            return df
        asked = df.select(F.col(col).alias("url")).where("url is not null").distinct()
        sizes = self.spark.createDataFrame([(s["id"], s["blocks"]) for s in live], "segment string, blocks long")
        filters = self.spark.read.schema("block long, bits binary, segment string").option("basePath", f"{self.root}/filters").parquet(
            *[f"{self.root}/filters/segment={s['id']}" for s in live])
        # a row a segment of the log: some tens
        places = asked.crossJoin(F.broadcast(sizes)).withColumn("block", _block("url", F.col("blocks"))).drop("blocks")
        maybe = places.join(filters, ["segment", "block"])
        for i in range(BITS):
            maybe = maybe.where(_is_set("bits", _bit("url", i)))
        from ..session import cut

        maybe = cut(maybe.select("url", "segment"), "maybe-visited")
        self.last_read = sorted(r[0] for r in maybe.select("segment").distinct().collect())
        if not self.last_read:
            return df
        # a URL is in one segment only, so which one it may be in needn't be asked again
        hits = self._read(self.last_read).join(maybe.select("url").distinct(), "url", "left_semi")
        return df.join(hits.select(F.col("url").alias(col)), col, "left_anti")

    def _write(self, urls: DataFrame, name: str, tier: int) -> dict | None:
        """A segment and its filter (not live before it is published); None without rows."""
        path = f"{self.root}/segments/{name}"
        urls.select("url").repartitionByRange("url").sortWithinPartitions("url").write.mode("overwrite").parquet(path)
        written = self.spark.read.schema("url string").parquet(path)
        rows = written.count()
        if not rows:
            return None
        blocks = -(-rows * BITS_A_URL // BLOCK)
        bits = written.select(_block("url", F.lit(blocks)).alias("block"), F.explode(F.array(*[_bit("url", i) for i in range(BITS)])).alias("bit"))
        (bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
         .write.mode("overwrite").parquet(f"{self.root}/filters/segment={name}"))
        return {"id": name, "tier": tier, "rows": rows, "blocks": blocks}

    def add(self, urls: DataFrame, run: str, batch: int, merge: bool = True) -> None:
        """Add the URLs that are new, as batch ``batch`` (rising) of ``run``; a batch that was added
        before is left out. Full tiers are then merged."""
        version, state = self._state()
        if state["batches"].get(run, -1) < batch:
            fresh = self.without(urls.select("url").where("url is not null").distinct())
            segment = self._write(fresh, f"{run}-{batch}", 0)
            state["batches"][run] = batch
            state["segments"] += [segment] if segment else []
            manifest.publish(self.spark, self.root, version, state)
        if merge:
            self.merge()

    def merge(self) -> None:
        """Merge full tiers until none is left."""
        while True:
            version, state = self._state()
            tiers: dict[int, list[dict]] = {}
            for s in state["segments"]:
                tiers.setdefault(s["tier"], []).append(s)
            full = min((t for t, s in tiers.items() if len(s) >= FANOUT), default=None)
            if full is None:
                return
            gone = {s["id"] for s in tiers[full]}
            merged = self._write(self._read(sorted(gone)), f"tier{full + 1}-{uuid.uuid4().hex}", full + 1)
            state["segments"] = [s for s in state["segments"] if s["id"] not in gone] + [merged]
            manifest.publish(self.spark, self.root, version, state)
