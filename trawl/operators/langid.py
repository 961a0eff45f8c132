"""Language identification: multinomial naive Bayes over character n-grams, trained and
scored as DataFrame jobs.

The reference calls a pre-trained naive-Bayes identifier and keeps the argmax label. Here the
same model family is trained from a labelled table (``documents(text, lang)``):

* text → lowercase, whitespace runs → one space; features are the character trigrams
  (code points) of every word padded with a space on each side, over the whole text;
* every gram of the training text is a feature (``V`` of them), none is cut;
* ``log P(g|l) = log((c(g,l)+1) / (T_l + V))``, ``log P(l)`` from document counts; label =
  argmax (ties → larger label); no known gram → argmax prior.

Scoring never materialises ``features × languages``: with ``d_l = log(1/(T_l+V))`` the score
is ``prior_l + n_feat·d_l + Σ cnt(g)·log(c(g,l)+1)``, so only grams that occur in a language's
training text carry a row. A model within a size bound is broadcast as sorted arrays and texts are
scored in the scan's tasks, an Arrow batch at a time; beyond the bound the grams of a text's distinct
words are joined with the per-gram table (AQE's skew split included). Both give the label and its
probability.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces
from ..functions.text import collapse_ws
from ..session import cut, ship_package

NGRAM = 3
#: A model of at most so many bytes is broadcast.
BROADCAST_BYTES = 64 << 20
#: Distinct grams of a language that a training task holds before it hands them on.
HELD_GRAMS = 1 << 18


def normalized(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(" "), F.lower(collapse_ws(F.coalesce(t, F.lit("")))), F.lit(" "))


def ngrams(text, n: int = NGRAM) -> Column:
    """Character trigrams of the normalised text, skipping those centred on a space.

    Equal to the trigrams of every word padded with one space on each side (word-boundary
    grams, no grams across two words). One linear regex pass with a capturing lookahead;
    per-index ``substring`` would be quadratic on long texts (code-point indexing).
    """
    if n != 3:
        raise ValueError("only trigrams are supported")
    return F.regexp_extract_all(normalized(text), F.lit("(?s)(?=(.[^ ].))"), 1)


#: Session setting: texts are dealt to so many tasks first (a table of few, large row groups can't be
#: split by its scan). Unset, they stay in the scan's splits.
PARTITIONS_KEY = "spark.trawl.textPartitions"


def _dealt(df: DataFrame, text: str) -> DataFrame:
    n = int(df.sparkSession.conf.get(PARTITIONS_KEY, "0"))
    return df.repartition(n, F.xxhash64(text)) if n else df


@dataclass
class LangModel:
    langs: list[str]  # label order used for the per-language score columns
    priors: dict[str, float]  # lang -> log prior
    defaults: dict[str, float]  # lang -> d_l
    n: int
    wide: DataFrame  # gram, __d0.. one column log(c + 1) per language (written once)
    size: int | None = None  # grams


def _gram_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(key, text)`` of every gram of normalised texts (each starts and ends with a space): three code
    points in one number."""
    texts = texts.fill_null(" ")
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    c = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    mid = np.flatnonzero(c != 0x20)
    return (c[mid - 1] << 42) | (c[mid] << 21) | c[mid + 1], np.searchsorted(np.cumsum(size), mid, side="right")


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    grams, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(grams), np.int64)
    np.add.at(out, at, counts)
    return grams, out


def _gram_rows(lang: str, grams: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    points = np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype("<u4")
    spelled = points.tobytes().decode("utf-32-le", "surrogatepass")
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(grams), pa.string()), pa.array([spelled[i:i + 3] for i in range(0, len(spelled), 3)], pa.string()),
         pa.array(count)], ["lang", "gram", "c"])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, normalised text) to (lang, gram, count), a row a task, language and gram (more rows beyond
    ``HELD_GRAMS`` of a language). Texts are counted a piece at a time."""
    have: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for part in pieces(batches, 1):
        langs = part.column(0).to_pylist()
        key, text = _gram_keys(part.column(1))
        for lang in sorted(set(langs)):
            mine = np.array([v == lang for v in langs], bool)
            grams, count = np.unique(key[mine[text]], return_counts=True)
            if lang in have:
                grams, count = _counted(np.concatenate([have[lang][0], grams]), np.concatenate([have[lang][1], count]))
            have[lang] = grams, count.astype(np.int64)
            if len(grams) > HELD_GRAMS:
                yield _gram_rows(lang, *have.pop(lang))
    for lang in sorted(have):
        yield _gram_rows(lang, *have[lang])


def train(docs: DataFrame, text: str = "text", label: str = "lang", n: int = NGRAM) -> LangModel:
    """Train from ``docs(text, lang)``: tasks count the grams of their texts, one exchange adds them up.
    Only per-language scalars reach the driver."""
    if n != NGRAM:
        raise ValueError("only trigrams are supported")
    labelled = docs.where(F.col(label).isNotNull())
    ship_package(docs.sparkSession)
    counts = cut(_dealt(labelled.select(label, text), text).select(F.col(label).cast("string").alias("lang"), normalized(text).alias("s"))
                 .mapInArrow(_gram_counts, "lang string, gram string, c long")
                 .groupBy("lang", "gram").agg(F.sum("c").alias("c")), "lang-counts")
    totals = {r["lang"]: float(r["t"]) for r in counts.groupBy("lang").agg(F.sum("c").alias("t")).collect()}
    docs_per_lang = {r["lang"]: r["d"] for r in labelled.groupBy(F.col(label).alias("lang"))
                     .agg(F.count(F.lit(1)).alias("d")).collect()}  # one row per language
    langs = sorted(docs_per_lang)
    wide = cut(counts.groupBy("gram").agg(
        *[F.sum(F.when(F.col("lang") == lg, F.log(F.col("c") + 1)).otherwise(0.0)).alias(f"__d{i}")
          for i, lg in enumerate(langs)]), "lang-wide")
    v = wide.count()
    all_docs = sum(docs_per_lang.values())
    priors = {lg: math.log(docs_per_lang[lg] / all_docs) for lg in langs}
    defaults = {lg: -math.log(totals.get(lg, 0.0) + v) if totals.get(lg, 0.0) + v else 0.0 for lg in langs}
    return LangModel(langs, priors, defaults, n, wide, v)


def classify(df: DataFrame, model: LangModel, text: str, key: str, out: str = "pred_lang", score: str = "score",
             broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(key, out, score)``: the argmax label of ``text`` for every row of ``df``, and its probability.

    A model of at most ``broadcast_bytes`` goes to the tasks as sorted arrays, and every text is scored
    in the scan's own task without an exchange. A larger one is joined by gram (``key`` must then be
    unique). A row without known grams gets the argmax prior.
    """
    size = model.wide.count() if model.size is None else model.size
    if size * 8 * (1 + len(model.langs)) > broadcast_bytes or not model.langs:
        return _classify_by_join(df, model, text, key, out, score)
    ship_package(df.sparkSession)
    rows = model.wide.select("gram", *[f"__d{i}" for i in range(len(model.langs))]).toArrow()
    grams = np.frombuffer("".join(rows.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64).reshape(-1, 3)
    keys = (grams[:, 0] << 42) | (grams[:, 1] << 21) | grams[:, 2]
    order = np.argsort(keys)
    weight = np.stack([rows.column(i + 1).to_numpy() for i in range(len(model.langs))], axis=1)[order] if len(keys) else np.zeros((0, len(model.langs)))
    sent = df.sparkSession.sparkContext.broadcast((keys[order], weight, [model.priors[v] for v in model.langs],
                                                   [model.defaults[v] for v in model.langs], model.langs))
    kind = df.select(key).schema[0].dataType.simpleString()
    return _dealt(df.select(key, text), text).select(F.col(key).alias(key), normalized(text).alias("__s")).mapInArrow(
        _scores(sent, key, out, score), f"`{key}` {kind}, `{out}` string, `{score}` double")


def _scores(sent, key: str, out: str, score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weight, prior, default, langs = sent.value
        for batch in pieces(batches, 1):
            n = batch.num_rows
            gram, text = _gram_keys(batch.column(1))
            at = np.minimum(np.searchsorted(keys, gram), max(len(keys) - 1, 0))
            known = keys[at] == gram if len(keys) else np.zeros(len(gram), bool)
            at, text = at[known], text[known]
            found = np.bincount(text, minlength=n)
            z = np.stack([prior[k] + found * default[k] + np.bincount(text, weight[at, k], n) for k in range(len(langs))], axis=1)
            best = len(langs) - 1 - np.argmax(z[:, ::-1], axis=1)  # ties: the larger label
            top = z[np.arange(n), best]
            p = 1 / np.exp(z - top[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([langs[k] for k in best], pa.string()), pa.array(p)], [key, out, score])

    return run


def _words(df: DataFrame, keys: list[Column], text: str) -> DataFrame:
    """Distinct words per key with their counts (``keys…, w, k``)."""
    names = [f"__k{i}" for i in range(len(keys))]
    return (df.select(*[k.alias(n) for k, n in zip(keys, names)], F.explode(F.split(normalized(text), " ")).alias("w"))
            .groupBy(*names, "w").agg(F.count(F.lit(1)).alias("k")))


def _classify_by_join(df: DataFrame, model: LangModel, text: str, key: str, out: str, score: str) -> DataFrame:
    """For models beyond the broadcast bound: words are counted per text, grams made per distinct word
    (outer, so an empty text keeps its row), joined to the per-gram table and summed per key. The
    aggregates hold only the key and numbers, so they are hash aggregates with map-side combining."""
    langs = model.langs
    words = _words(df, [F.col(key)], text)
    occ = words.select(F.col("__k0").alias("__key"), "k", F.explode_outer(ngrams("w", model.n)).alias("gram"))
    hit = occ.join(model.wide, "gram", "left")
    known = F.when(F.col("__d0").isNotNull(), F.col("k")).otherwise(0) if langs else F.lit(0)
    sums = hit.groupBy("__key").agg(F.sum(known).alias("__nf"),
                                    *[F.coalesce(F.sum(F.col(f"__d{i}") * F.col("k")), F.lit(0.0)).alias(f"__s{i}")
                                      for i in range(len(langs))])
    if not langs:
        return sums.select(F.col("__key").alias(key), F.lit(None).cast("string").alias(out), F.lit(None).cast("double").alias(score))
    each = [F.lit(model.priors[lg]) + F.col("__nf") * F.lit(model.defaults[lg]) + F.col(f"__s{i}") for i, lg in enumerate(langs)]
    scored = [F.struct(s.alias("s"), F.lit(lg).alias("l")) for s, lg in zip(each, langs)]
    best = F.greatest(*scored) if len(langs) > 1 else scored[0]
    total = sum((F.exp(s - best["s"]) for s in each[1:]), F.exp(each[0] - best["s"]))
    return sums.select(F.col("__key").alias(key), best["l"].alias(out), (1 / total).alias(score))


def language_gate(model: LangModel, target: str):
    """A crawl gate: label each fetched page's text (paragraphs joined by a space, F4) and
    accept it when the label is ``target`` (P8). Takes ``(keyword, url, paragraphs)`` of the
    fetched pages, gives ``(keyword, url, lang, accepted, score)``."""

    def gate(df: DataFrame) -> DataFrame:
        page = df.select(F.struct("keyword", "url").alias("page"), F.array_join("paragraphs", " ").alias("__t"))
        lab = classify(page, model, "__t", "page", out="lang")
        return lab.select("page.keyword", "page.url", "lang", (F.col("lang") == F.lit(target)).alias("accepted"), "score")

    return gate


def save(model: LangModel, path: str) -> None:
    """Write the model to an explicit path (a version per path; an existing one is refused):
    per-gram table + per-language scalars (one small JSON row)."""
    spark = model.wide.sparkSession
    model.wide.write.parquet(f"{path}/wide")
    meta = json.dumps({"langs": model.langs, "priors": model.priors, "defaults": model.defaults, "n": model.n, "size": model.size})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.parquet(f"{path}/meta")


def load(spark, path: str) -> LangModel:
    """Read a model that ``save`` wrote."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    return LangModel(meta["langs"], meta["priors"], meta["defaults"], meta["n"], spark.read.parquet(f"{path}/wide"), meta.get("size"))
