"""Operator 9, token counts by a separator scan over flat token streams.

A flat stream is token ids one after the other, an end-of-document id after each document, and no
index. It comes as blocks ``(file, block, data)`` of little-endian ids that know nothing of
document boundaries. A task finds the separators of a block with one vectorised search and keeps
a few numbers: the tokens in the block, the separators, the distances between them, and how much
of a document sticks out at either end. Blocks are then stitched by a prefix scan (running sums and
a running maximum of the last separator's place): first within segments of ``SEGMENT`` blocks, then
over the segments, so a file of any length is not one task's work.

``encode_documents`` makes such streams from a table (one stream a partition), ``token_files``
reads them from files of any size, each task its own places. The tokenizer's vocabulary file is a parameter; texts that spell a special
token are ordinary text, so they never make a separator.

Defined results: null and empty texts are documents of 0 tokens; ids after the last separator are
one more, unterminated document; a stream without separators is one unterminated document; empty
streams and tables give no rows; repeated rows count each on their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, ship_package

#: Token ids in a block, blocks in a segment.
BLOCK = 1 << 18
SEGMENT = 1024
#: Blocks of files that one task should read.
FILE_BLOCKS = 128
#: Fixed value: how the vocabulary's tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The end-of-document id of that vocabulary.
SEPARATOR = 50256


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level BPE tokenizer of a vocabulary file (base64 token and rank per line)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """``docs(doc_id, text)`` to stream blocks ``(file, block, data, ids)``.

    ``ids`` is the side list of the documents whose separators lie in the block, in order."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file, number = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        parts, have, ids, end = [], 0, [], np.array([separator], "<u4")

        def out(chunk, who):
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([str(file)]), pa.array([number - 1], pa.int64()), pa.array([chunk.astype("<u4").tobytes()], pa.binary()),
                 pa.array([who], pa.list_(id_type))], ["file", "block", "data", "ids"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_py()
                parts += [enc.encode_to_numpy(t, disallowed_special=()) if t else end[:0], end]
                have += len(parts[-2]) + 1
                ids.append((have, who))
                if have >= block:
                    flat = np.concatenate(parts)
                    at = 0
                    while len(flat) - at >= block:
                        yield out(flat[at:at + block], [w for e, w in ids if at < e <= at + block])
                        at += block
                    parts, have = [flat[at:]], len(flat) - at
                    ids = [(e - at, w) for e, w in ids if e > at]
        if have:
            yield out(np.concatenate(parts), [w for _, w in ids])

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"file string, block long, data binary, ids array<{kind}>")


def _read_ranges(batches: Iterator[pa.RecordBatch], block: int, width: int) -> Iterator[pa.RecordBatch]:
    """(file, block) to the block's ids, each read from its place in the file."""
    for batch in batches:
        for name, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with open(name.removeprefix("file:"), "rb") as stream:
                stream.seek(k * block * width)
                ids = np.frombuffer(stream.read(block * width), f"<u{width}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())],
                                             ["file", "block", "data"])


def record_bytes(length: int, block: int, width: int) -> int:
    """The largest record of whole ids, a block at most, that a file of ``length`` bytes is made of."""
    ids = length // width
    return width * next(k for k in range(min(block, max(ids, 1)), 0, -1) if ids % k == 0)


def _store_file(spark: SparkSession, name: str, length: int, block: int, width: int) -> DataFrame:
    """Blocks of one file in a store that only Spark reaches: records of equal length, which Spark splits
    over tasks (blocks are as long as a record that divides the file)."""
    size = record_bytes(length, block, width)
    records = spark.sparkContext.newAPIHadoopFile(
        name, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable", conf={"fixedlengthinputformat.record.length": str(size)})
    rows = records.map(lambda r: (name, r[0] // size, bytearray(np.frombuffer(bytes(r[1]), f"<u{width}").astype("<u4").tobytes())))
    return spark.createDataFrame(rows, "file string, block long, data binary")


def token_files(spark: SparkSession, path: str, block: int = BLOCK, width: int = 4) -> DataFrame:
    """Flat token files (``width`` bytes an id, little-endian) as blocks ``(file, block, data)``.

    Files may be of any size: only their names and lengths are listed, and every task reads its own
    blocks from their places. A length that is no whole number of ids is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    odd = files.where(F.col("length") % width != 0).first()
    if odd is not None:
        raise ValueError(f"{odd.path}: {odd.length} bytes are not a whole number of {width}-byte ids")
    files = files.where("length > 0")
    local = F.col("path").startswith("file:")
    many = F.ceil(F.col("length") / (block * width)).cast("long")
    total = files.where(local).agg(F.coalesce(F.sum(many), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // FILE_BLOCKS))
    places = (files.where(local).select("path", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("block"))
              .repartition(tasks, "path", "block"))
    out = places.mapInArrow(lambda batches: _read_ranges(batches, block, width), "file string, block long, data binary")
    for name, length in files.where(~local).collect():
        out = out.union(_store_file(spark, name, length, block, width))
    return out


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """One narrow row a block: ``tokens``, the separators' places ``at``, each one's ``gap`` to the
    one before it in the block (and the side columns)."""
    side = [c for c in blocks.columns if c not in ("file", "block", "data")]
    src = blocks.select("data", "file", "block", *side)
    names = [*src.columns[1:], "tokens", "at", "gap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places, gaps = [], [], []
            for data in batch.column(0):
                flat = np.frombuffer(data.as_py(), "<u4")
                tokens.append(len(flat))
                places.append(np.flatnonzero(flat == separator))
                gap = pa.array(np.diff(places[-1], prepend=0), mask=np.arange(len(places[-1])) == 0)
                gaps.append(gap.to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(tokens, pa.int64()), pa.array(places, pa.list_(pa.int64())),
                                              pa.array(gaps, pa.list_(pa.int64()))], names)

    ddl = ", ".join(f"`{c}` {t}" for c, t in src.dtypes[1:]) + ", tokens long, at array<long>, gap array<long>"
    return src.mapInArrow(run, ddl)


def stitch(scanned: DataFrame) -> DataFrame:
    """Scanned blocks to documents: ``file, ordinal, start, n_tokens, terminated`` (and the side
    lists' entries, one a separator)."""
    side = [c for c in scanned.columns if c not in ("file", "block", "tokens", "at", "gap")]
    inside = Window.partitionBy("file", "seg").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = (scanned.withColumn("seg", F.floor(F.col("block") / SEGMENT))
             .withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
             .withColumn("last", F.col("start") + F.try_element_at("at", F.lit(-1))))
    local = local.withColumns({"base": F.coalesce(F.sum(F.size("at")).over(before), F.lit(0)), "prev": F.max("last").over(before)})
    totals = local.groupBy("file", "seg").agg(F.sum("tokens").alias("t"), F.sum(F.size("at")).alias("s"), F.max("last").alias("l"))
    across = Window.partitionBy("file").orderBy("seg")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"seg_start": F.coalesce(F.sum("t").over(earlier), F.lit(0)), "seg_base": F.coalesce(F.sum("s").over(earlier), F.lit(0))})
    totals = totals.withColumns({"seg_last": F.col("seg_start") + F.col("l")})
    totals = totals.withColumns({"seg_prev": F.max("seg_last").over(earlier), "final": F.lead("seg").over(across).isNull()})
    placed = local.join(totals.select("file", "seg", "seg_start", "seg_base", "seg_prev"), ["file", "seg"])
    prev = F.coalesce(F.col("seg_start") + F.col("prev"), F.col("seg_prev"), F.lit(-1))
    # a document runs from after the separator before it (perhaps blocks ago) to its own
    placed = placed.select("file", (F.col("base") + F.col("seg_base")).alias("b"), prev.alias("prev"),
                           (F.col("start") + F.col("seg_start")).alias("o"), F.posexplode(F.arrays_zip("at", "gap", *side)).alias("i", "d"))
    end = F.col("d.at") + F.col("o")
    begin = F.coalesce(end - F.col("d.gap"), F.col("prev")) + 1
    complete = placed.select("file", (F.col("b") + F.col("i")).cast("long").alias("ordinal"), begin.alias("start"),
                             (end - begin).alias("n_tokens"), F.lit(True).alias("terminated"), *[F.col(f"d.{c}").alias(c) for c in side])
    # what follows the last separator of a file
    whole = totals.groupBy("file").agg(F.sum("t").alias("t"), F.sum("s").alias("ordinal"), F.coalesce(F.max("seg_last"), F.lit(-1)).alias("l"))
    side_types = dict(scanned.dtypes)
    rest = whole.where("t - l - 1 > 0").select(
        "file", F.col("ordinal").cast("long"), (F.col("l") + 1).alias("start"), (F.col("t") - F.col("l") - 1).alias("n_tokens"), F.lit(False).alias("terminated"),
        *[F.lit(None).cast(side_types[c][len("array<"):-1]).alias(c) for c in side])
    return complete.union(rest)


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """Documents of flat streams with their token counts. The scan's narrow rows are written once
    (the prefix scan reads them more than once)."""
    return stitch(cut(scan_blocks(blocks, separator), "separators"))
