"""File sources and sinks in the reference's formats, as Spark readers and writers.

* word dictionary: a JSON array of objects (only ``word`` is read);
* keyword CSV: header ``words``, first column by position, consumed in order;
* corpus CSV: ``keyword,url,text`` in Python's default CSV dialect (minimal quoting,
  doubled quotes, ``\\r\\n``), rolled into shards by size;
* visited CSV: header ``URL``.

Spark's CSV defaults differ from Python's dialect (backslash escapes, outer whitespace
trimmed on write, a row split at embedded newlines on read), so every reader and writer
here sets the dialect explicitly. One difference remains: Spark's writer turns a newline
inside a quoted field into the row separator ``\r\n``; corpus paragraphs never hold one
(whitespace is collapsed before writing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ws import WS
from ..session import cut
from .splits import BLOCK_BYTES, file_blocks, read_csv, read_json_array

# Python csv dialect, spelled as Spark options.
PY_CSV_WRITE = dict(header=True, quote='"', escape='"', lineSep="\r\n", emptyValue="",
                    ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8")
PY_CSV_READ = dict(header=True, quote='"', escape='"', multiLine=True, emptyValue="",
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_words_json(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """JSON-array dictionary files → ``word``, a large file by many tasks. An object without
    ``word`` reads as NULL (the reference raises there); such rows are dropped."""
    return read_json_array(spark, path, "word string", block_bytes).where(F.col("word").isNotNull()).select("word")


def write_keyword_csv(words: DataFrame, path: str, col: str = "word") -> None:
    """K1: keyword CSV with header ``words``."""
    words.select(F.col(col).alias("words")).write.options(**PY_CSV_WRITE).csv(path)


def read_keyword_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Keyword CSV → ``keyword`` (the first column by position, all strings, no inference)
    with its queue order ``seq`` = (file, block, row in the block); a large file by many tasks."""
    df = read_csv(spark, path, encoding, block_bytes)
    return df.select(df[df.columns[3]].alias("keyword"), F.struct("file", "start", "row").alias("seq"))


def reencode_csv(spark: SparkSession, src: str, src_encoding: str, dst: str, dst_encoding: str = "UTF-8") -> None:
    """S3 + K5: rewrite a CSV from ``src_encoding`` to ``dst_encoding`` (same columns, rows in order,
    a large file by many tasks)."""
    df = read_csv(spark, src, src_encoding)
    opts = dict(PY_CSV_WRITE, encoding=dst_encoding)
    df.drop(*df.columns[:3]).write.options(**opts).csv(dst)


def by_shard(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` dealt by ``shard``, in ``order``: a shard is written by one task (a large one by as many as
    AQE splits it into), so that files grow with the shards and not with shards x tasks."""
    return rows.hint("rebalance", "shard").sortWithinPartitions("shard", *order)


def write_corpus_shards(rows: DataFrame, path: str, mode: str = "append") -> None:
    """K3: ``(shard, keyword, url, text)`` → one folder per shard, header in every file."""
    (rows.select("shard", "keyword", "url", "text").write.mode(mode)
     .partitionBy("shard").options(**PY_CSV_WRITE).csv(path))


def _flat_shard(file: str) -> F.Column:
    return F.regexp_extract(file, "corpus_([0-9]+)[.]csv$", 1).try_cast("int")


def flat_shards(spark: SparkSession, path: str) -> DataFrame:
    """``(file, shard)`` of the numbered files of a flat folder (only listed)."""
    files = cut(file_blocks(spark, f"{path.rstrip('/')}/corpus_*.csv", 1 << 62).select("file"), "flat-files")
    return files.select("file", _flat_shard("file").alias("shard")).where("shard is not null")


def read_flat_corpus(spark: SparkSession, path: str | list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A folder of flat ``corpus_<n>.csv`` files (or some of its files), with the columns of
    ``read_corpus`` (``shard`` = n; columns by position), a large file by many tasks. ``row_pos`` orders rows
    inside a file: a block's first byte plus the row's number in the block, which stays under the next block's."""
    where = f"{path.rstrip('/')}/corpus_*.csv" if isinstance(path, str) else path
    df = read_csv(spark, where, block_bytes=block_bytes)
    keyword, url, text = (F.col(f"`{c}`") for c in df.columns[3:6])
    return df.select(keyword.alias("keyword"), url.alias("url"), F.coalesce(text, F.lit("")).alias("text"),
                     _flat_shard("file").alias("shard"),
                     F.col("file").alias("file_name"), (F.col("start") + F.col("row")).alias("row_pos"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus shards → ``(keyword, url, text, shard, file_name, row_pos)``. ``file_name``
    is the full path, so string order visits ``shard=10`` before ``shard=2`` as the reference's
    name-sorted glob visits ``corpus_10`` before ``corpus_2`` (O1); ``row_pos`` orders rows
    inside a file (one file is read by one task, in order)."""
    df = (spark.read.options(**PY_CSV_READ).schema("keyword string, url string, text string, shard int")
          .csv(path))
    return df.select("keyword", "url", F.coalesce("text", F.lit("")).alias("text"), "shard",
                     F.col("_metadata.file_path").alias("file_name"),
                     F.monotonically_increasing_id().alias("row_pos"))


def drop_bad_bytes(col: str) -> F.Column:
    """Undecodable bytes dropped; a U+FFFD that was validly encoded stays. (It is parked as a
    newline, which a line doesn't hold, while the invalid ones are taken out.)"""
    parked = F.replace(F.col(col), F.lit("\ufffd"), F.lit("\n"))
    return F.replace(F.replace(F.make_valid_utf8(parked), F.lit("\ufffd"), F.lit("")), F.lit("\n"), F.lit("\ufffd"))


def read_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Physical lines of text files, undecodable bytes dropped, ends stripped → ``(file_name, line_pos, line)``."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    line = drop_bad_bytes("value")
    return df.select(F.col("_metadata.file_path").alias("file_name"),
                     F.monotonically_increasing_id().alias("line_pos"),
                     F.regexp_replace(line, f"^{WS}+|{WS}+$", "").alias("line"))


def url_tokens(lines: DataFrame) -> DataFrame:
    """P13 + F12: skip blank lines and ``url …`` headers; first token before a space."""
    tok = F.substring_index("line", " ", 1)
    return (lines.where((F.col("line") != "") & ~F.lower("line").startswith("url "))
            .select("file_name", "line_pos", tok.alias("URL")).where(F.col("URL") != ""))


def first_seen(urls: DataFrame, order: list[str], col: str = "URL") -> DataFrame:
    """D3: one row per URL with the position where it was first seen (hash aggregate)."""
    best = F.min(F.struct(*order)).alias("first")
    return urls.groupBy(col).agg(best)


def visited_urls(tokens: DataFrame, dedupe: bool = True) -> DataFrame:
    """D3 with the reference's ``dedupe`` flag: one row per URL at its first position, or
    (``dedupe=False``) every token in file/line order. ``pos`` = ``(file_name, line_pos)``.
    The unique count (A7) is ``count_distinct(URL)`` either way."""
    if not dedupe:
        return tokens.select("URL", F.struct("file_name", "line_pos").alias("pos"))
    return first_seen(tokens, ["file_name", "line_pos"]).withColumnRenamed("first", "pos")


def write_visited_csv(urls: DataFrame, path: str, col: str = "URL", order: str | None = None) -> None:
    """K4: visited CSV with header ``URL``; with ``order`` the rows of the part files, taken in
    name order, follow it (a range shuffle, no single task)."""
    if order is not None:
        urls = urls.repartitionByRange(order).sortWithinPartitions(order)
    urls.select(F.col(col).alias("URL")).write.options(**PY_CSV_WRITE).csv(path)


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """Write each partition as one JSON-array document (the dictionary file format), an object
    a line: brackets and commas are rows of their own around the native JSON of each row."""
    doc = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    placed = rows.select(F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"), doc.alias("value"))
    # a partition's first row opens its array, its last one closes it
    inside = Window.partitionBy("__p").orderBy("__i")
    marked = placed.select("__p", "__i", F.concat(F.when(F.row_number().over(inside) == 1, "[").otherwise(","), "value",
                                                  F.when(F.lead("__i").over(inside).isNull(), "]").otherwise("")).alias("value"))
    marked.sortWithinPartitions("__p", "__i").select("__p", "value").write.partitionBy("__p").text(path)
