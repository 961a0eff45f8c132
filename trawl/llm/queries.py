"""Registered queries of the training-data operators, with production parameters.

Each ``opN_<name>`` runs its operator over the whole table and derives the contract's columns
from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, embed_dedup, language_svm, line_dedup, mixing, ordinal, separator_scan, simhash_anchor, spelling, substring_blocks, suffix_dedup, toxicity


#: Share of the tokens that each domain should have.
TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_suffix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_matches(docs, _table(spark, sf_dir, "benchmark"), window=10)
    items = decontaminate.items_of("match.matches")
    hit = decontaminate.n_hit("match.matches")
    return out.select("doc_id", F.col("match.n_words").alias("n_words"), hit.alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op2_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_anchor.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select("doc_id", simhash_anchor.hex64("fp").alias("fingerprint"), "component_id")


def op3_merged_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    kept = F.col("repeats.kept")
    return out.select("doc_id", "repeats.n_bytes", (F.col("repeats.n_bytes") - F.length(kept)).cast("long").alias("n_removed"),
                      F.size("repeats.spans").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the labels: 0 bad, 1 good but toxic, 2 good."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).alias("grade"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ordinal.grade(docs, graded(_table(spark, sf_dir, "labels")))
    usable, clean = F.get("quality.tails", F.lit(0)), F.get("quality.tails", F.lit(1))
    return out.select("doc_id", "quality.expected_grade", usable.alias("p_usable"), clean.alias("p_clean"),
                      F.coalesce(usable >= 0.5, F.lit(True)).alias("kept"))


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled documents' domains: their language."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = mixing.mix(docs, labelled_domains(docs, _table(spark, sf_dir, "labels")), TARGETS, keep=["doc_id"])
    return out.select("doc_id", "mix.n_tokens", "mix.posterior", "mix.rate")


def op6_deletion_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    out = language_svm.identify(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang"), learn=part != 2)
    return out.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")


def op8_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    out = toxicity.score(docs, _table(spark, sf_dir, "labels"), learn=part != 0)
    return out.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = separator_scan.encode_documents(_table(spark, sf_dir, "documents"))
    out = separator_scan.count_tokens(blocks)
    return out.select(F.col("ids").alias("doc_id"), "file", "ordinal", "start", "n_tokens")


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by the CRC-32 of ``conv_id:turn``."""
    space = F.lit(" ")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                                        text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def op11_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    edits, totals = conversation_repair.repair(damaged(rows))
    ids = rows.groupBy(conversation_repair.conversation_key().alias("key")).agg(F.max("conv_id").alias("conv_id"))
    out = ids.join(totals.drop("conv_id"), "key", "left").join(conversation_repair.digests(edits), "key", "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_blocks.remove_repeats(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "repeats.n_words", substring_blocks.words_in("repeats.spans").alias("n_removed"),
                      F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op13_permuterm(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_length=7)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    typo = spelling.without_code_point(F.col("run"), (h % F.char_length("run")).cast("int"))
    words = runs.select(F.when(h % 31 == 0, typo).otherwise(F.col("run")).alias("word"))
    out = spelling.group_variants(words, min_length=7, min_count=2, ratio=10)
    return out.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_suffix_search": op1_suffix_search,
    "op2_simhash_anchor": op2_simhash_anchor,
    "op3_merged_bwt": op3_merged_bwt,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op5_soft_mixing": op5_soft_mixing,
    "op6_deletion_lines": op6_deletion_lines,
    "op7_family_svm": op7_family_svm,
    "op8_weak_toxicity": op8_weak_toxicity,
    "op9_separator_scan": op9_separator_scan,
    "op10_cross_polytope": op10_cross_polytope,
    "op11_prefix_doubling": op11_prefix_doubling,
    "op12_block_anchors": op12_block_anchors,
    "op13_permuterm": op13_permuterm,
}

ORACLE: dict[str, str] = {
    "op1_suffix_search": decontaminate.ORACLE,
    "op3_merged_bwt": suffix_dedup.ORACLE,
    "op6_deletion_lines": line_dedup.ORACLE,
    "op10_cross_polytope": embed_dedup.ORACLE,
    "op11_prefix_doubling": conversation_repair.ORACLE,
    "op12_block_anchors": substring_blocks.ORACLE,
    "op13_permuterm": spelling.ORACLE,
}
