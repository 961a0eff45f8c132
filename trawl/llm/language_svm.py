"""Operator 7, language identification in two steps.

First the language family (one linear support vector machine against the rest per family), then
one-versus-one support vector machines between the languages of that family. Features are the
shares of hashed byte trigrams of the whole text, so classifying is a mean of looked-up weights
per text: no shuffle, and only the fixed-size weights are broadcast.

The fit uses at most ``PER_LANGUAGE`` labelled texts of each language (the same ones each run), as
trigram shares made in many tasks. A doc_id that repeats counts once a language, by the text of least
hash, and never lends its text to another row's language.

Defined results: a null text or one without letters is ``und`` with score 0; without any labelled
text everything is ``und``; a single learned language is predicted for all other texts; ties go
to the first in name order; other columns pass through.
"""

from __future__ import annotations

import io
import json
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linear import (
    TRIGRAM_BITS,
    fit_in_task,
    fit_svm,
    fresh,
    sample_texts,
    score_texts,
    sigmoid,
    trigram_sample,
    trigram_scores,
    trigrams_of,
)

PER_LANGUAGE = 1500
UNKNOWN = "und"
#: Language families by ISO code; a language not listed is its own family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "uz"),
    "uralic": ("et", "fi", "hu"),
}
_LETTER = re.compile(r"[^\W\d_]")


def family(lang: str) -> str:
    code = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, members in FAMILIES.items() if code in members), lang)


def train(table: pa.Table) -> bytes:
    """Sample (lang, trigram shares) to packed weights: family machines, then the pairs in each family."""
    langs = np.array(table.column("lang").to_pylist(), object)
    x = trigrams_of(table)
    names = sorted(set(langs))
    fams = sorted({family(v) for v in names})
    of = np.array([family(v) for v in langs], object)
    width, cols = 1 << TRIGRAM_BITS, []

    def machine(rows, sign):
        cols.append(fit_svm(x.take(rows), sign, width, steps=200, rate=0.1, l2=1e-5))

    if len(fams) > 1:
        for f in fams:
            machine(np.arange(len(langs)), np.where(of == f, 1.0, -1.0))
    pairs = []
    for f in fams:
        for a, b in combinations([v for v in names if family(v) == f], 2):
            rows = np.flatnonzero((langs == a) | (langs == b))
            machine(rows, np.where(langs[rows] == a, 1.0, -1.0))
            pairs.append((a, b))
    w = np.stack([c[0] for c in cols], axis=1) if cols else np.zeros((width, 0), np.float32)
    out = io.BytesIO()
    np.savez(out, w=w.astype(np.float32), b=np.array([c[1] for c in cols]),
             names=np.frombuffer(json.dumps([names, fams, pairs]).encode(), np.uint8))
    return out.getvalue()


def load(raw: bytes):
    got = np.load(io.BytesIO(raw))
    names, fams, pairs = json.loads(got["names"].tobytes())
    return got["w"], got["b"], names, fams, pairs


def predict(model, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins (texts, machines) to language numbers and scores in 0..1."""
    _, _, names, fams, pairs = model
    n = len(z)
    heads = len(fams) if len(fams) > 1 else 0
    fam = z[:, :heads].argmax(axis=1) if heads else np.zeros(n, int)
    sure = sigmoid(3 * z[np.arange(n), fam]) if heads else np.ones(n)
    best, score = np.zeros(n, int), np.zeros(n)
    for f, fname in enumerate(fams):
        mine = [k for k, v in enumerate(names) if family(v) == fname]
        rows = np.flatnonzero(fam == f)
        won, margin = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
        for k, (a, b) in enumerate(pairs):
            a, b = names.index(a), names.index(b)
            if a in mine:
                m = z[rows, heads + k]
                won[:, a] += m >= 0
                won[:, b] += m < 0
                margin[:, a] += sigmoid(3 * m)
                margin[:, b] += sigmoid(-3 * m)
        value = won[:, mine] + margin[:, mine] / (2 * len(names))
        top = np.array(mine)[value.argmax(axis=1)] if len(rows) else np.zeros(0, int)
        best[rows] = top
        score[rows] = sure[rows] * (margin[np.arange(len(rows)), top] / (len(mine) - 1) if len(mine) > 1 else 1.0)
    return best, score


def _score(model, col, data, off):
    best, score = predict(model, trigram_scores(data, off, model[0]) + model[1])
    letters = [bool(t) and _LETTER.search(t) is not None for t in col.to_pylist()]
    names = [model[2][k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters)]
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], ["lang_pred", "score"])


def identify(docs: DataFrame, labelled: DataFrame, learn: Column | None = None, per_language: int = PER_LANGUAGE,
             name: str = "language") -> DataFrame:
    """``docs`` with a struct column (``lang_pred``, ``score``).

    ``labelled(doc_id, text, lang)`` is learned from where ``lang`` is given and ``learn`` holds."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        known = known.where(learn)
    # a bounded number of rows of each language: first a cut by hash in every task, then the rank
    order = F.xxhash64(F.col("doc_id").cast("string"), "lang")
    counts = known.groupBy("lang").count()
    some = known.select("doc_id", "lang").join(F.broadcast(counts), "lang")  # a row a language, as the model has
    some = some.where(F.pmod(order, F.lit(1 << 20)) <= F.lit(float(1 << 20)) * per_language * 1.5 / F.col("count") + 64)
    ranked = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id")))
    chosen = ranked.where(F.col("k") <= per_language).select("doc_id", "lang").distinct()
    raw = fit_in_task(trigram_sample(sample_texts(known, chosen, ("doc_id", "lang"))), train)
    name = fresh(docs, name)
    struct = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    if raw is None:
        return docs.withColumn(name, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))
    sent = docs.sparkSession.sparkContext.broadcast(load(raw))
    return score_texts(docs, sent, _score, "struct<lang_pred: string, score: double>", struct, name)
