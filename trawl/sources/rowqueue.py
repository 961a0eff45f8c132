"""Keyword files as a queue of rows: a streaming source whose offset is (file, row).

The reference pops one row of a keyword file at a time. Here a batch is the next ``rowsPerBatch``
rows of a drop folder, wherever files begin and end, and the query's checkpoint holds the place: the
file (its time and name), the byte and the row up to which the queue was taken. Files are read in order
of time and name, so a drop must be moved in whole and not changed; one that is dated before the place
the queue has reached is not read. After a restart the queue goes on with the next row.

The driver only looks for the byte at which the next ``rowsPerBatch`` rows end, a step at a time, and
holds none of them; tasks read the rows, up to ``ROWS_PER_TASK`` each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import splits
from .splits import STEP, _csv_ends, csv_rows, open_file

ROWS_PER_TASK = 100_000
SCHEMA = "keyword string, mtime long, file string, row long"


class _Rows(InputPartition):
    def __init__(self, mtime: int, file: str, begin: int, end: int, row: int, rows: int):
        self.mtime, self.file, self.begin, self.end, self.row, self.rows = mtime, file, begin, end, row, rows


def _drops(root: str) -> list[tuple[int, str, int]]:
    """The files of the folder as ``(time, name, size)``, in order."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.mtime_ns, f.base_name, f.size) for f in found
                  if f.is_file and f.size and not f.base_name.startswith(("_", ".")))


def rows_end(f, at: int, size: int, rows: int) -> tuple[int, int]:
    """Where the next ``rows`` records from byte ``at`` (a record's start) end, and how many there are.
    A last line without a newline is a record."""
    f.seek(at)
    place, end, have, state = at, at, 0, 0
    while have < rows and place < size:
        data = f.read(min(STEP, size - place))
        ends, state = _csv_ends(data, state)
        take = min(len(ends), rows - have)
        if take:
            end, have = place + int(ends[take - 1]) + 1, have + take
        place += len(data)
    if have < rows and end < size:
        end, have = size, have + 1
    return end, have


class _QueueReader(DataSourceStreamReader):
    def __init__(self, root: str, rows: int, encoding: str):
        self.root, self.rows, self.encoding = root.rstrip("/"), rows, encoding
        self.place: dict | None = None  # up to where rows were handed out; the checkpoint's word counts

    def _open(self, name: str):
        return open_file(f"{self.root}/{name}")

    def initialOffset(self) -> dict:
        return {"mtime": 0, "file": "", "byte": 0, "row": 0}

    def _ahead(self, start: dict, rows: int, until: dict | None = None) -> Iterator[_Rows]:
        """The next ``rows`` rows after ``start`` as parts of files, up to ``until``; ``row`` 0 is a header."""
        for mtime, name, size in _drops(self.root):
            here = (start["mtime"], start["file"])
            if (mtime, name) < here or not rows:
                continue
            at, row = (start["byte"], start["row"]) if (mtime, name) == here else (0, 0)
            if until is not None:
                if (mtime, name) > (until["mtime"], until["file"]):
                    return
                if (mtime, name) == (until["mtime"], until["file"]):
                    size = until["byte"]
            with self._open(name) as f:
                while at < size and rows:
                    head = 1 if at == 0 else 0
                    end, have = rows_end(f, at, size, min(rows, ROWS_PER_TASK) + head)
                    yield _Rows(mtime, name, at, end, row, have)
                    at, row, rows = end, row + have, rows - (have - head)

    def latestOffset(self) -> dict:
        self.place = self.place or self.initialOffset()
        for part in self._ahead(self.place, self.rows):
            self.place = {"mtime": part.mtime, "file": part.file, "byte": part.end, "row": part.row + part.rows}
        return self.place

    def partitions(self, start: dict, end: dict):
        # a restarted query names its last place here before it asks for new rows
        if self.place is None:
            self.place = end
        if start == end:
            return []
        return list(self._ahead(start, 1 << 62, until=end))

    def read(self, partition: _Rows):
        with self._open(partition.file) as f:
            f.seek(partition.begin)
            body = f.read(partition.end - partition.begin)
        first = partition.begin == 0
        for i, cells in enumerate(csv_rows(body, self.encoding, first)):
            yield cells[0], partition.mtime, partition.file, partition.row + i + (1 if first else 0)


class KeywordQueue(DataSource):
    """``keyword_queue``: options ``path`` (a folder of keyword CSV files with a header),
    ``rowsPerBatch`` (1) and ``encoding`` (UTF-8)."""

    @classmethod
    def name(cls) -> str:
        return "keyword_queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _QueueReader(self.options["path"], int(self.options.get("rowsPerBatch", "1")),
                            self.options.get("encoding", "UTF-8"))


def keyword_queue(spark: SparkSession, path: str, rows_per_batch: int = 1, encoding: str = "UTF-8") -> DataFrame:
    """Stream of ``keyword`` with its queue order ``seq`` = (time of the file, file, row),
    ``rows_per_batch`` rows a batch. Start it with a time trigger (``drain`` in ``streaming.intake``):
    ``availableNow`` fixes its end by one batch."""
    # sent by value: the process that plans a source's batches doesn't get the package's files
    mine = [sys.modules[__name__], splits]
    for module in mine:
        cloudpickle.register_pickle_by_value(module)
    try:
        spark.dataSource.register(KeywordQueue)
    finally:
        for module in mine:
            cloudpickle.unregister_pickle_by_value(module)
    rows = (spark.readStream.format("keyword_queue").option("path", path).option("rowsPerBatch", rows_per_batch)
            .option("encoding", encoding).load())
    return rows.select("keyword", F.struct("mtime", "file", "row").alias("seq"))
