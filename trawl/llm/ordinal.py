"""Operator 4, quality as an ordinal grade: cumulative-link regression on hashed text.

``P(grade >= g) = sigmoid(s(text) - threshold[g])`` with one weight vector for all grades and
ordered thresholds. The score ``s`` sums the weights of the text's token set and the mean weights
of its byte trigrams. The fit runs on a bounded sample of graded rows; scoring covers every whole
text, without a shuffle, and gives the expected grade and all tail probabilities.

Defined results: null, empty and word-less texts get the thresholds' own probabilities; without
any graded row the expected grade is 0 and there are no tails; a single grade is every text's
grade; equal texts get equal results; other columns pass through.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import (
    TOKEN_WIDTH,
    TRIGRAM_BITS,
    Rows,
    bounded,
    fit,
    fit_in_task,
    fresh,
    lean,
    sample_texts,
    score_texts,
    sigmoid,
    token_counts,
    token_rows,
    token_scores,
    tokens_in,
    trigram_rows,
    trigram_scores,
)

#: Graded rows that the regression is fitted on, at most.
SAMPLE = 6000
#: Standard errors by which a token must lean to one side of a threshold to be a feature.
CLEAR = 6.0


def thresholds(par: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first is free, the gaps are exponentials."""
    return par[0] + np.concatenate([[0.0], np.cumsum(np.exp(par[1:]))])


def tails(s: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade >= g) for g = 1..K-1, one column each."""
    return sigmoid(s[:, None] - theta[None, :])


def slope_of(y: np.ndarray, grades: int):
    """Slopes of the mean negative log likelihood by score and by threshold parameter."""
    n, rows = max(len(y), 1), np.arange(len(y))

    def slope(z, par):
        theta = thresholds(par)
        up = np.concatenate([np.ones((len(y), 1)), tails(z[:, 0], theta), np.zeros((len(y), 1))], axis=1)
        d = up * (1 - up)
        p = np.maximum(up[rows, y] - up[rows, y + 1], 1e-9)
        low, high = d[rows, y] / p / n, d[rows, y + 1] / p / n
        g = -(low - high)
        by_theta = np.bincount(y, low, grades + 1)[1:grades] - np.bincount(y + 1, high, grades + 1)[1:grades]
        gaps = np.exp(par[1:])
        return g[:, None], np.concatenate([[by_theta.sum()], gaps * np.cumsum(by_theta[::-1])[::-1][1:]])

    return slope


def both(texts: pa.Array, y: np.ndarray, grades: int) -> Rows:
    """Token sets (those features that lean clearly to a side of some threshold) next to trigram
    shares."""
    up = np.stack([np.ones(len(y)), *((y >= g).astype(float) for g in range(1, grades))])
    many, *inside = token_counts(texts, up)
    z = [np.abs(lean(many, i, len(y), w.sum())) for i, w in zip(inside, up[1:])]
    a, b = token_rows(texts, np.max(z, axis=0) > CLEAR), trigram_rows(texts)
    row = np.concatenate([a.row, b.row])
    order = np.argsort(row, kind="stable")
    ptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(a)))])
    return Rows(ptr, np.concatenate([a.idx, b.idx + TOKEN_WIDTH])[order], np.concatenate([a.val, b.val])[order])


def train(table: pa.Table) -> bytes:
    """Sample (text, grade) to packed weights and thresholds."""
    y = table.column("grade").to_numpy().astype(int)
    grades = int(y.max()) + 1
    width = TOKEN_WIDTH + (1 << TRIGRAM_BITS)
    if grades > 1:
        x = both(table.column("text").combine_chunks(), y, grades)
        w, par = fit(x, 1, width, slope_of(y, grades), extra=grades - 1, steps=150, rate=0.05, l2=1e-4)
        w, theta = w[:, 0], thresholds(par)
    else:
        w, theta = np.zeros(width, np.float32), np.zeros(0)
    out = io.BytesIO()
    np.savez_compressed(out, w=w, theta=theta)
    return out.getvalue()


def load(raw: bytes):
    got = np.load(io.BytesIO(raw))
    w = got["w"]
    return w[:TOKEN_WIDTH], w[TOKEN_WIDTH:, None], got["theta"], tokens_in(w[:TOKEN_WIDTH] != 0)


def _score(model, _col, data, off):
    tok, tri, theta, some = model
    t = tails(token_scores(data, off, tok, some) + trigram_scores(data, off, tri)[:, 0], theta)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * t.shape[1], pa.int32()), pa.array(t.ravel()))
    return pa.StructArray.from_arrays([pa.array(t.sum(axis=1)), lists], ["expected_grade", "tails"])


def grade(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, name: str = "quality") -> DataFrame:
    """``docs`` with a struct column: ``expected_grade`` and ``tails`` (P(grade >= 1), ...).

    ``ratings(doc_id, grade)``: grades 0, 1, 2, ...; several for a document count as their maximum."""
    known = (ratings.where("doc_id is not null and grade >= 0").groupBy("doc_id")
             .agg(F.max("grade").cast("int").alias("grade")))
    raw = fit_in_task(sample_texts(docs, bounded(known, sample)), train)
    name = fresh(docs, name)
    if raw is None:
        return docs.withColumn(name, F.struct(F.lit(0.0).alias("expected_grade"), F.array().cast("array<double>").alias("tails")))
    sent = docs.sparkSession.sparkContext.broadcast(load(raw))
    kind = pa.struct([("expected_grade", pa.float64()), ("tails", pa.list_(pa.float64()))])
    return score_texts(docs, sent, _score, "struct<expected_grade: double, tails: array<double>>", kind, name)
