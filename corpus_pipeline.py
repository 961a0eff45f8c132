"""The corpus pipeline: documents through the filtering, dedup and mixing stages.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``; the last adds
each document's ``rate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import decontaminate as contamination
from trawl.llm import line_dedup as lines
from trawl.llm import mixing, simhash_anchor
from trawl.llm import toxicity as toxic
from trawl.llm.queries import TARGETS, labelled_domains
from trawl.llm.textbytes import fresh
from trawl.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxic.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go from the texts; documents that consist of them go."""
    return lines.drop_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within 4 bits (shingles of 4 words) stays."""
    return simhash_anchor.drop_near_duplicates(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    return contamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"), window=10)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its rate; those at rate 0 go."""
    name = fresh(docs, "mix")
    out = mixing.mix(docs, labelled_domains(docs, _table(spark, sf_dir, "labels")), TARGETS, name=name)
    return out.where(F.col(f"{name}.rate") > 0).select(*docs.columns, F.col(f"{name}.rate").alias(fresh(docs, "rate")))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing_to_targets),
]

#: Fitted classifiers and SimHash groups can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
