"""Corpus statistics, running totals and size-rolled shards.

Running totals over a global order (the reference logs them per page as it goes) are done
without a single-partition window and without Python: narrow rows (order key and numbers) are
range-partitioned, summed inside their ranges, and lifted by the totals of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import char_count

# Fixed values (must equal the reference's).
BYTES_PER_CHAR = 1.1
SHARD_BYTES = 100 * 1024 * 1024


def page_chars() -> F.Column:
    """Characters of a page's paragraphs."""
    return F.aggregate("paragraphs", F.lit(0).cast("long"), lambda acc, x: acc + char_count(x))


def observed(analyzed: DataFrame) -> tuple[DataFrame, Observation]:
    """A2/A3 as a by-product: the pages with an observation of pages processed, pages with text,
    paragraphs and characters, filled by the first action that runs over them (so by the writing
    pass; the pages are not parsed again for the numbers)."""
    seen = Observation()
    n = F.size("paragraphs")
    return analyzed.observe(seen, F.count(F.lit(1)).alias("pages_processed"), F.count(F.when(n > 0, 1)).alias("pages_with_text"),
                            F.sum(n.cast("long")).alias("paragraphs"), F.sum(page_chars()).alias("characters")), seen


def corpus_stats(analyzed: DataFrame, group: list[str]) -> DataFrame:
    """A2/A3/F13/F14 per group: pages processed, pages with text, paragraphs, characters, GB estimate."""
    per_page = analyzed.select(*group, F.size("paragraphs").alias("n_paras"), page_chars().alias("n_chars"))
    chars = F.sum("n_chars")
    return per_page.groupBy(*group).agg(
        F.count(F.lit(1)).alias("pages_processed"),
        F.count(F.when(F.col("n_paras") > 0, 1)).alias("pages_with_text"),
        F.sum("n_paras").cast("long").alias("paragraphs"),
        chars.cast("long").alias("characters"),
        (chars * F.lit(BYTES_PER_CHAR) / F.lit(1e9)).alias("est_gb"),
    )


def running_totals(df: DataFrame, order: list[str], sums: list[str], n_partitions: int | None = None) -> DataFrame:
    """Add ``<c>_before`` (exclusive) and ``<c>_total`` (inclusive) running sums of ``sums``
    over the global ``order`` (must be unique and not null), plus ``row_no`` (1-based).

    The input is written once. Its order key and numbers go through one range shuffle; windows
    run inside a range, one row per range carries the totals across, and the wide rows are
    joined back by the key.
    """
    from ..session import cut

    df = cut(df, "running-input")
    narrow = df.select(*order, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in sums])
    ranged = narrow.repartitionByRange(n_partitions, *order) if n_partitions else narrow.repartitionByRange(*order)
    # the range number is fixed by this write (it is read three times below)
    ranged = cut(ranged.withColumn("__range", F.spark_partition_id()), "running-ranges")
    inside = Window.partitionBy("__range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select(*order, "__range", F.row_number().over(inside).cast("long").alias("row_no"),
                          *sums, *[F.sum(c).over(upto).alias(f"{c}_total") for c in sums])
    totals = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(c).alias(f"__{c}") for c in sums])
    # one row per range: at most the session's number of shuffle partitions
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    lift = totals.select("__range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_lift")
                                      for c in ("__rows", *[f"__{c}" for c in sums])])
    out = local.join(lift, "__range").select(
        *order, (F.col("row_no") + F.col("__rows_lift")).alias("row_no"),
        *[x for c in sums for x in ((F.col(f"{c}_total") + F.col(f"__{c}_lift") - F.col(c)).alias(f"{c}_before"),
                                    (F.col(f"{c}_total") + F.col(f"__{c}_lift")).alias(f"{c}_total"))])
    return df.join(out, order)


def csv_row_bytes(cols: list[str]) -> F.Column:
    """Bytes of one row as Python's ``csv.writer`` writes it (minimal quoting, ``\\r\\n``)."""
    parts = []
    for c in cols:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quote = v.rlike('[,"\\r\\n]')
        parts.append(F.octet_length(v) + F.when(quote, F.lit(2) + F.length(v) - F.length(F.replace(v, F.lit('"'), F.lit("")))).otherwise(0))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total + F.lit(len(cols) - 1 + 2)


def corpus_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """The last shard of a written corpus and the bytes of its rows; ``(1, 0)`` before the first
    write. Only the last shard is read (the partition filter prunes the others)."""
    from pyspark.errors import AnalysisException

    from ..sources.files import read_corpus

    try:
        corpus = read_corpus(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 1, 0
        raise
    last = corpus.agg(F.max("shard")).first()[0]
    if last is None:
        return 1, 0
    size = corpus.where(F.col("shard") == last).agg(F.sum(csv_row_bytes(["keyword", "url", "text"]))).first()[0]
    return int(last), int(size or 0)


def assign_shards(rows: DataFrame, order: list[str], limit_bytes: int = SHARD_BYTES,
                  cols: tuple[str, ...] = ("keyword", "url", "text"), state: tuple[int, int] = (1, 0)) -> DataFrame:
    """K3: ``shard`` = shards filled by the bytes written before this row, 1-based like
    ``corpus_<n>``. ``state`` (``corpus_state``) continues an existing corpus: its last shard is
    filled up first.

    A shard is left once it has reached the limit; a shard may overshoot by one row.
    """
    first, have = state
    sized = rows.withColumn("row_bytes", csv_row_bytes(list(cols)).cast("long"))
    run = running_totals(sized, order, ["row_bytes"])
    return run.withColumn("shard", (F.floor((F.col("row_bytes_before") + F.lit(have)) / F.lit(limit_bytes)) + F.lit(first)).cast("int"))
