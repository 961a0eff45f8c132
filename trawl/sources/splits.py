"""Large CSV and JSON-array files, read by many tasks a file.

A quoted CSV field may hold newlines and a JSON string may hold braces, so what a byte means depends on
all quotes before it. Files are cut into blocks of ``block_bytes``. A first pass counts, in every block,
what it changes: quotes (odd or even) and, for JSON, nesting outside strings under both possible states
at its start. A prefix sum over the blocks of a file (one row a block) then gives every block its state,
and in a second pass every task parses from a safe place: a record belongs to the block that holds its
first byte, and its task reads on past the block's end to finish it. Files of one block skip the first
pass. Nothing but block rows is shuffled; a task holds one block and the record that leaves it.

Tasks open files themselves: local paths directly, others through ``pyarrow.fs`` (``hdfs``, ``s3``,
``gs``). Charsets must keep ASCII bytes to themselves (UTF-8, Latin-1, the Windows pages).
"""

from __future__ import annotations

import codecs
import csv
import io
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship_package

BLOCK_BYTES = 16 << 20
STEP = 1 << 20  # bytes read at a time past a block's end
ROWS_OUT = 10_000  # rows handed back at a time
MAX_TASKS = 20_000  # tasks over all blocks (a task takes several blocks beyond that)

QUOTE, NEWLINE = 0x22, 0x0A
_ESCAPED = re.compile(rb"\\.", re.DOTALL)


def open_file(uri: str):
    """Random access to a file by its URI, as a binary file object."""
    if uri.startswith("file:"):
        return open("/" + uri[5:].lstrip("/"), "rb")
    if "://" not in uri:
        return open(uri, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def file_blocks(spark: SparkSession, path: str | list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row ``(file, size, start)`` per block of the files under ``path`` (no content is read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0"))
    return files.select("file", "size", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long"))).alias("start"))


def _spread(blocks: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks dealt to tasks in file and byte order, so the order of tasks and rows is the files' order:
    a task takes one whole block, or many small files."""
    # opening a file counts as a 64th of a block
    part = F.least(F.col("size") - F.col("start"), F.lit(block_bytes)) + F.lit(block_bytes / 64)
    n, load = blocks.agg(F.count(F.lit(1)), F.sum(part)).first()
    tasks = max(1, min(n, MAX_TASKS, math.ceil((load or 0) / block_bytes)))
    return blocks.repartitionByRange(tasks, "file", "start").sortWithinPartitions("file", "start")


def _states(spark: SparkSession, path: str, block_bytes: int, scan: Callable) -> DataFrame:
    """``(file, size, start, quoted, depth)``: the state at the start of every block.

    ``scan(f, start, end)`` gives what a block changes: quotes mod 2, and nesting if it starts outside
    and inside quotes."""
    ship_package(spark)
    blocks = cut(file_blocks(spark, path, block_bytes), "file-blocks")
    schema = "file string, size long, start long, flips int, outside long, inside long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for file, size, start in pdf.itertuples(index=False):
                with open_file(file) as f:
                    found.append((file, size, start, *scan(f, start, min(start + block_bytes, size))))
            yield pd.DataFrame(found, columns=["file", "size", "start", "flips", "outside", "inside"])

    large = cut(_spread(blocks.where(F.col("size") > block_bytes), block_bytes).mapInPandas(run, schema), "block-states")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quoted = large.withColumn("quoted", (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).cast("int"))
    gain = F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside"))
    nested = quoted.withColumn("depth", F.coalesce(F.sum(gain).over(before), F.lit(0)))
    small = (blocks.where(F.col("size") <= block_bytes)
             .withColumn("quoted", F.lit(0)).withColumn("depth", F.lit(0).cast("long")))
    states = nested.select(*small.columns).unionByName(small)
    return cut(states, "block-starts")


def _records(states: DataFrame, block_bytes: int, fields: list[str], parse: Callable) -> DataFrame:
    """``(file, start, row, *fields)`` from ``parse(f, start, end, size, quoted, depth)`` of every block."""
    keys = [T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("row", T.LongType())]
    schema = T.StructType(keys + [T.StructField(c, T.StringType()) for c in fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, size, start, quoted, depth in pdf.itertuples(index=False):
                at, rows = 0, []

                def out():
                    frame = pd.DataFrame(rows, columns=fields, dtype=object)
                    frame.insert(0, "file", file)
                    frame.insert(1, "start", start)
                    frame.insert(2, "row", range(at, at + len(rows)))
                    return frame

                with open_file(file) as f:
                    for row in parse(f, start, min(start + block_bytes, size), size, quoted, depth):
                        rows.append(row)
                        if len(rows) == ROWS_OUT:
                            yield out()
                            at, rows = at + len(rows), []
                if rows:
                    yield out()

    return _spread(states, block_bytes).mapInPandas(run, schema)


# -- CSV ------------------------------------------------------------------------------


def _csv_scan(f, start: int, end: int) -> tuple[int, int, int]:
    f.seek(start)
    quotes = 0
    while start < end:
        data = f.read(min(STEP, end - start))
        quotes += data.count(b'"')
        start += len(data)
    return quotes % 2, 0, 0


def _csv_ends(data: bytes, quoted: int) -> tuple[np.ndarray, int]:
    """Places of the newlines that end a record, and the state after ``data``."""
    raw = np.frombuffer(data, np.uint8)
    state = np.bitwise_xor.accumulate((raw == QUOTE).view(np.uint8)) ^ np.uint8(quoted)
    return np.flatnonzero((raw == NEWLINE) & (state == 0)), int(state[-1]) if len(state) else quoted


def csv_body(f, start: int, end: int, size: int, quoted: int) -> bytes:
    """The bytes of the records whose first byte lies in ``[start, end)``; ``quoted``: the quotes
    before ``start``, mod 2."""
    at = max(start - 1, 0)  # the byte before tells whether a record starts at ``start``
    f.seek(at)
    data = f.read(end - at)
    before = quoted ^ (1 if start and data[:1] == b'"' else 0)
    ends, state = _csv_ends(data, before)
    first = 0
    if start:
        if not len(ends) or at + int(ends[0]) + 1 >= end:
            return b""  # no record starts here
        first = int(ends[0]) + 1
    if len(ends) and int(ends[-1]) == len(data) - 1:
        return data[first:]
    parts, place = [data[first:]], end
    while place < size:
        more = f.read(min(STEP, size - place))
        ends, state = _csv_ends(more, state)
        if len(ends):
            parts.append(more[:int(ends[0]) + 1])
            break
        parts.append(more)
        place += len(more)
    return b"".join(parts)


def csv_rows(body: bytes, encoding: str, first_block: bool) -> Iterator[list[str]]:
    """Records of Python's CSV dialect; blank lines, and the header of a file's first block, are left out."""
    csv.field_size_limit(2**31 - 1)
    if first_block and body.startswith(codecs.BOM_UTF8):
        body = body[len(codecs.BOM_UTF8):]
    rows = csv.reader(io.StringIO(body.decode(encoding, "replace"), newline=""))
    if first_block:
        next(rows, None)
    return (r for r in rows if r)


def read_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """CSV files in Python's default dialect (header, minimal or full quoting, doubled quotes) →
    ``(file, start, row, <columns of the header>)``, all strings, by many tasks a file.

    ``(file, start, row)`` is the order of the rows. Missing cells are null, empty cells empty, cells
    beyond the header dropped; undecodable bytes become U+FFFD. A quote inside an unquoted field is not
    of this dialect. An empty folder of files without bytes raises as Spark's reader does."""
    from .files import PY_CSV_READ

    fields = spark.read.options(**PY_CSV_READ).option("encoding", encoding).csv(path).columns
    width = len(fields)

    def parse(f, start, end, size, quoted, depth):
        for r in csv_rows(csv_body(f, start, end, size, quoted), encoding, start == 0):
            yield r[:width] + [None] * (width - len(r))

    return _records(_states(spark, path, block_bytes, _csv_scan), block_bytes, fields, parse)


# -- JSON arrays ----------------------------------------------------------------------


def _unescaped(f, start: int, end: int) -> bytes:
    """The bytes with escape pairs blanked; a pair may have begun before ``start`` (backslashes only
    stand in strings, so pairing from the start of their run is right)."""
    run, at = 0, start
    while at:
        step = min(at, 4096)
        f.seek(at - step)
        head = f.read(step)
        slashes = step - len(head.rstrip(b"\\"))
        run, at = run + slashes, at - step
        if slashes < step:
            break
    f.seek(start)
    data = f.read(end - start)
    if run % 2 and data:
        data = b" " + data[1:]
    return _ESCAPED.sub(b"  ", data)


def _json_levels(data: bytes, quoted: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, whether each stands in a string, and the nesting after each."""
    raw = np.frombuffer(data, np.uint8)
    inside = (np.bitwise_xor.accumulate((raw == QUOTE).view(np.uint8)) ^ np.uint8(quoted)) == 1
    step = ((raw == 0x7B) | (raw == 0x5B)).astype(np.int8) - ((raw == 0x7D) | (raw == 0x5D)).astype(np.int8)
    step[inside] = 0
    return raw, inside, np.cumsum(step, dtype=np.int32) + depth


def _json_scan(f, start: int, end: int) -> tuple[int, int, int]:
    data = _unescaped(f, start, end)
    raw, _, outside = _json_levels(data, 0, 0)
    inside = _json_levels(data, 1, 0)[2]
    return int(np.count_nonzero(raw == QUOTE)) % 2, int(outside[-1]), int(inside[-1])


def json_objects(f, start: int, end: int, size: int, quoted: int, depth: int) -> Iterator[list[str]]:
    """The texts of the objects of a top-level array whose first byte lies in ``[start, end)``."""
    raw, inside, level = _json_levels(_unescaped(f, start, end), quoted, depth)
    begins = np.flatnonzero((raw == 0x7B) & ~inside & (level == 2))
    ends = np.flatnonzero((raw == 0x7D) & ~inside & (level == 1))
    if not len(begins):
        return
    ends = ends[ends > begins[0]]
    f.seek(start)
    data = f.read(end - start)
    for b, e in zip(begins.tolist(), ends.tolist()):
        yield [data[b:e + 1].decode("utf-8", "replace")]
    if len(ends) == len(begins):
        return
    parts, place, now, deep = [data[int(begins[-1]):]], end, int(inside[-1]), int(level[-1])
    while place < size:
        upto = min(place + STEP, size)
        raw, inside, level = _json_levels(_unescaped(f, place, upto), now, deep)
        done = np.flatnonzero((raw == 0x7D) & ~inside & (level == 1))
        f.seek(place)
        if len(done):
            parts.append(f.read(int(done[0]) + 1))
            yield [b"".join(parts).decode("utf-8", "replace")]
            return
        parts.append(f.read(upto - place))
        place, now, deep = upto, int(inside[-1]), int(level[-1])
    # an object that the file never closes is left out


def read_json_array(spark: SparkSession, path: str, schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Files of one JSON array of objects each (UTF-8) → ``(file, start, row, <schema>)``, an object a
    row, by many tasks a file. Elements that are no objects are left out; a broken object gives nulls."""
    states = _states(spark, path, block_bytes, _json_scan)
    objects = _records(states, block_bytes, ["object"], json_objects)
    return objects.select("file", "start", "row", F.from_json("object", schema).alias("o")).select("file", "start", "row", "o.*")
