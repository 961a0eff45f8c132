"""A corpus that grows by atomic appends, with the counters of every append.

An append writes its rows into a folder of its own and then publishes a manifest (``sources.manifest``):
the live folders, the last shard and its bytes, and what the writing pass counted. Until then nothing of
it is seen, so a writer that stops half-way leaves the corpus as it was. The manifest is published only
if the version that the shards were counted from is still the last one; otherwise another writer came
came first, and the rows, which are written already, are given their shards anew from its state.

A corpus may begin with a folder of flat ``corpus_<n>.csv`` files (``adopt``): they stay where they are,
are read as shards, and the first append goes on where they end.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import BYTES_PER_CHAR, SHARD_BYTES, assign_shards, csv_row_bytes
from ..session import cut
from . import manifest
from .files import PY_CSV_READ, by_shard, flat_shards, read_flat_corpus, write_corpus_shards

COLUMNS = ["keyword", "url", "text"]
SCHEMA = "keyword string, url string, text string, append string, shard int"
ATTEMPTS = 20  # writers that may come first before an append gives up with ``VersionTaken``


class CorpusTable:
    """The corpus under ``root``: size-rolled shards of CSV files, continued over appends."""

    def __init__(self, spark: SparkSession, root: str, limit_bytes: int = SHARD_BYTES):
        self.spark, self.root, self.limit = spark, root.rstrip("/"), limit_bytes

    def _folder(self, name: str) -> str:
        return f"{self.root}/data/append={name}"

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return (self.spark.read.options(**PY_CSV_READ).option("basePath", f"{self.root}/data").schema(SCHEMA)
                .csv([self._folder(n) for n in names]))

    def state(self) -> tuple[int, int]:
        """The last shard and the bytes of its rows; ``(1, 0)`` before the first append."""
        live = manifest.read(self.spark, self.root)[1]
        return live.get("shard", 1), live.get("bytes", 0)

    def adopt(self, folder: str) -> tuple[int, int]:
        """Begin the corpus with the flat files of ``folder``; the new state. The file of the highest
        number is filled up first (row bytes, without headers); lower ones are not gone back to."""
        version, live = manifest.read(self.spark, self.root)
        if live:
            raise ValueError(f"{self.root}: the corpus has begun")
        read_flat_corpus(self.spark, folder)  # raises where there is nothing to adopt
        state, files = (1, 0), flat_shards(self.spark, folder)
        top = files.agg(F.max("shard")).first()[0]
        while top is not None:  # usually once: a file without rows doesn't count
            names = [r["file"] for r in files.where(F.col("shard") == top).collect()]
            have = read_flat_corpus(self.spark, names).agg(F.sum(csv_row_bytes(COLUMNS))).first()[0]
            if have is not None:
                state = (int(top), int(have))
                break
            top = files.where(F.col("shard") < top).agg(F.max("shard")).first()[0]
        manifest.publish(self.spark, self.root, version, {"appends": [], "shard": state[0], "bytes": state[1], "flat": folder})
        return state

    def rows(self) -> DataFrame:
        """``(keyword, url, text, shard, file_name, row_pos)`` of the adopted files and all published
        appends; ``file_name`` orders shards by name and, inside a shard, the adopted file and then
        appends as they were published."""
        live = manifest.read(self.spark, self.root)[1]
        df = self._read([a["name"] for a in live.get("appends", [])])
        last = F.element_at(F.split("path", "/"), -1)
        path = F.input_file_name().alias("path")
        named = df.select(*COLUMNS, "append", "shard", path, F.monotonically_increasing_id().alias("row_pos"))
        out = named.select("keyword", "url", F.coalesce("text", F.lit("")).alias("text"), "shard",
                           F.concat(F.lit("shard="), "shard", F.lit("/"), "append", F.lit("/"), last).alias("file_name"), "row_pos")
        if "flat" not in live:
            return out
        flat = read_flat_corpus(self.spark, live["flat"]).where("shard is not null")
        return flat.withColumn("file_name", F.concat(F.lit("shard="), "shard", F.lit("/"))).unionByName(out)

    def append(self, rows: DataFrame, order: list[str], counters: Observation | None = None) -> dict:
        """Append ``rows`` (``keyword, url, text`` and the unique ``order`` columns): K3, one commit.

        ``counters`` is an observation inside the plan of ``rows`` (``operators.corpus.observed``); its
        numbers come from the pass that writes the rows. Returns the append's entry in the manifest."""
        begun = time.monotonic()
        rows = cut(rows.select(*order, *[c for c in COLUMNS if c not in order]), "append-rows")
        seen = counters.get if counters is not None else {}
        for attempt in range(ATTEMPTS):
            version, live = manifest.read(self.spark, self.root)
            state = live.get("shard", 1), live.get("bytes", 0)
            name = f"{version + 1:012d}-{uuid.uuid4().hex}"
            written = Observation()
            sharded = by_shard(assign_shards(rows, order, self.limit, state=state), order).observe(
                written, F.count(F.lit(1)).alias("rows"), F.sum("row_bytes").alias("row_bytes"), F.max("shard").alias("last"))
            write_corpus_shards(sharded, self._folder(name), "errorifexists")
            counted = dict(written.get)
            last = counted.pop("last")
            entry = {"name": name, **{k: int(v or 0) for k, v in {**counted, **seen}.items()},
                     "seconds": time.monotonic() - begun}
            shard, have = self._last(name, last, state) if entry["rows"] else state
            appends = live.get("appends", [])
            try:
                manifest.publish(self.spark, self.root, version, {
                    **live, "appends": [*appends, entry], "shard": shard, "bytes": have})
                return entry
            except manifest.VersionTaken:
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError("not reached")

    def _last(self, name: str, shard: int, state: tuple[int, int]) -> tuple[int, int]:
        """The state after append ``name``, whose last shard is ``shard``; only that shard is read."""
        size = int(self._read([name]).where(F.col("shard") == shard).agg(F.sum(csv_row_bytes(COLUMNS))).first()[0])
        return shard, size + (state[1] if shard == state[0] else 0)

    def counters(self) -> DataFrame:
        """A row per append with what its writing pass counted, the size estimate and
        the running characters; columns that an append didn't observe are null."""
        appends = manifest.read(self.spark, self.root)[1].get("appends", [])
        counted = ["rows", "row_bytes", "pages_processed", "pages_with_text", "paragraphs", "characters"]
        out, total = [], 0
        for i, a in enumerate(appends):
            total += a.get("characters", 0)
            out.append((i + 1, *[a.get(c) for c in counted], total, total * BYTES_PER_CHAR / 1e9, a["seconds"]))
        return self.spark.createDataFrame(out, "append long, " + ", ".join(f"{c} long" for c in counted)
                                          + ", characters_total long, est_gb_total double, seconds double")
