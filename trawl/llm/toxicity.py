"""Operator 8, toxicity by weak supervision.

Voters look at whole texts of a bounded sample of labelled and of unlabelled rows: a stated
lexicon (one voter a word), lexicons mined from the labelled part (tokens and word stems that go
with the label, dealt to ``MINED`` voters), text patterns, and one voter for "nothing of the mined
lexicon", which speaks for clean text. A generative label model (two classes, a firing rate by
voter and class) is fitted by expectation maximisation; a given label is one more, fallible voter.
The voters' correlations given the class are estimated under the posterior, and correlated voters
share one weight. The posterior labels train a linear classifier over those hashed tokens that
speak clearly for the class, and that alone scores all texts, in full, without a shuffle.

Defined results: null, empty and word-less texts get the classifier's base score; without any
usable label every score is 0; equal texts get equal scores; other columns pass through.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship_package
from .linear import (
    TOKEN_BITS,
    TOKEN_WIDTH,
    Rows,
    bounded,
    fit_in_task,
    fit_logistic,
    fresh,
    lean,
    release,
    sample_texts,
    score_texts,
    sigmoid,
    token_counts,
    token_rows,
    token_scores,
    tokens_in,
)
from .textbytes import LOWER, span_hash

#: Labelled rows that the voters and the classifier are fitted on, at most; as many unlabelled ones.
SAMPLE = 8000
#: Standard errors by which a token must lean to the class to be in a lexicon or in the classifier:
#: a base, and so much more each time the class doubles (copies of a text make chance pairs).
CLEAR, CLEARER = 4.0, 0.6
MINED, MINED_TOKENS = 24, 600
L2 = 1e-4
#: How far the label model trusts a given label.
LABEL_TRUST = 0.97
#: Insults, one voter each.
LEXICON = ("idiot", "stupid", "moron", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown",
           "dumb", "ugly", "filthy", "vermin", "imbecile")
#: Text patterns, one voter each.
PATTERNS = (rb"!{3,}", rb"\b(you are|you're|ur) (an? |such )?\w+", rb"(?i)\b(shut up|get lost|go away)\b", rb"\b[A-Z]{4,}( [A-Z]{4,}){2,}")

#: Voters: mined lexicons, stated words, patterns, and the one for clean text.
VOTERS = MINED + len(LEXICON) + len(PATTERNS) + 1


def pattern_votes(texts: pa.Array) -> np.ndarray:
    found = [re.compile(p) for p in PATTERNS]
    return np.array([[bool(p.search(t.as_py() or b"")) for p in found] for t in texts.cast(pa.binary())], bool).reshape(-1, len(found))


def _word_id(word: str) -> int:
    data = np.frombuffer(word.encode().translate(LOWER), np.uint8)
    return int(span_hash(data, np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - TOKEN_BITS))


def telling(many: np.ndarray, inside: np.ndarray, n: float, n1: float) -> np.ndarray:
    """By feature, by how many standard errors its texts lean to class 1, and 0 unless that is
    clear and holds in most of its texts. (What merely goes with a language that has more of the
    class doesn't count.) ``many``: texts that have it, ``inside``: those of class 1."""
    z = lean(many, inside, n, n1)
    return np.where((z > CLEAR + CLEARER * np.log2(max(n1, 2))) & (inside > 0.6 * many), z, 0)


def votes(x: Rows, texts: pa.Array, mined: np.ndarray) -> np.ndarray:
    """Firing matrix (texts, voters)."""
    voter = np.full(TOKEN_WIDTH, -1)
    voter[mined] = np.arange(len(mined)) % MINED
    out = np.zeros((len(x), MINED), bool)
    hit = voter[x.idx] >= 0
    out[x.row[hit], voter[x.idx[hit]]] = True
    words = np.zeros((len(x), len(LEXICON)), bool)
    for k, w in enumerate(LEXICON):
        words[x.row[x.idx == _word_id(w)], k] = True
    return np.concatenate([out, words, pattern_votes(texts), ~out.any(axis=1, keepdims=True)], axis=1)


def label_model(fired: np.ndarray, label: np.ndarray, rounds: int = 50):
    """Posterior of class 1 per row; the voters' firing rates by class, and their weights after
    the correlations."""
    v = fired.astype(float)
    known = label >= 0
    trust = np.where(label == 1, LABEL_TRUST, 1 - LABEL_TRUST)
    seen = np.where(known, np.log(trust) - np.log(1 - trust), 0.0)
    # unlabelled rows start as the labelled share, tilted by whether a mined lexicon fires
    q = np.where(known, trust, np.where(fired[:, -1], 0.05, 0.6))
    share = np.ones(v.shape[1])
    for step in range(rounds):
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        rate1 = (q @ v + 0.5) / (q.sum() + 1)
        rate0 = ((1 - q) @ v + 0.5) / ((1 - q).sum() + 1)
        if step % 10 == 0:  # correlation given the class: what a voter repeats of the others
            r1, r0 = v - rate1, v - rate0
            cov = (r1 * q[:, None]).T @ r1 + (r0 * (1 - q)[:, None]).T @ r0
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rho = np.clip(np.abs(cov) / sd[:, None] / sd[None, :], 0, 1)
            np.fill_diagonal(rho, 0)
            share = 1 / (1 + (rho * (rho > 0.05)).sum(axis=1))
        gain = v * (np.log(rate1) - np.log(rate0)) + (1 - v) * (np.log(1 - rate1) - np.log(1 - rate0))
        gain[:, -1] *= v[:, -1]  # the voter for clean text abstains where it doesn't fire
        z = np.log(prior) - np.log(1 - prior) + gain @ share + seen
        new = sigmoid(z)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q, rate1, rate0, share


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled (text, y) to (feature, texts that have it, those of class 1), a row a feature and task."""
    total = None
    for b in batches:
        y = b.column(1).to_numpy().astype(float)
        part = token_counts(b.column(0), np.stack([np.ones(len(y)), y]))
        total = part if total is None else total + part
    if total is not None:
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["feature", "many", "inside"])
    release()


def _featured(wanted: np.ndarray, mined: np.ndarray):
    """(key, y, text) to (key, y, wanted features, voters that fire)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(TOKEN_WIDTH, bool)
        mask[wanted] = True
        for b in batches:
            x = token_rows(b.column(2), mask)
            fired = votes(x, b.column(2), mined)
            row, voter = np.nonzero(fired)
            fires = np.append(0, np.cumsum(np.bincount(row, minlength=len(x))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(x.ptr.astype(np.int32)), pa.array(x.idx.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(fires.astype(np.int32)), pa.array(voter.astype(np.int32)))],
                ["key", "y", "features", "fired"])
        release()

    return run


def train(table: pa.Table) -> bytes:
    """Sample (y, -1 for unlabelled; wanted features; fired voters) to a packed classifier."""
    table = table.combine_chunks()
    y = table.column("y").to_numpy().astype(float)
    lists = [pa.concat_arrays(table.column(c).chunks) for c in ("features", "fired")]
    ptr = [np.append(0, np.cumsum(v.value_lengths().to_numpy())) for v in lists]
    flat = [v.flatten().to_numpy() for v in lists]
    x = Rows(ptr[0], flat[0], np.ones(len(flat[0]), np.float32))
    fired = np.zeros((len(y), VOTERS), bool)
    fired[np.repeat(np.arange(len(y)), np.diff(ptr[1])), flat[1]] = True
    q, *_ = label_model(fired, y)
    weight = np.where(q > 0.5, 0.5 / max((q > 0.5).mean(), 1e-3), 0.5 / max((q <= 0.5).mean(), 1e-3)) ** 0.5
    w, b = fit_logistic(x, q, TOKEN_WIDTH, weight, steps=300, rate=0.08, l2=L2)
    w[np.abs(w) < 1e-3] = 0
    out = io.BytesIO()
    np.savez_compressed(out, w=w, b=b)
    return out.getvalue()


def fitted(docs: DataFrame, chosen: DataFrame) -> bytes | None:
    """The classifier from the texts of the chosen ids (``doc_id, y``, a bounded table). Tokens are
    counted and texts turned to features in many tasks; the task that fits gets wanted features
    and fired voters only. None without texts."""
    ship_package(docs.sparkSession)
    # one row of equal texts, the labelled one if there is any
    sample = cut(sample_texts(docs, chosen).select("y", F.coalesce("text", F.lit("")).alias("text"))
                 .groupBy(F.sha2("text", 256).alias("key")).agg(F.max("y").alias("y"), F.first("text").alias("text")), "toxicity-sample")
    labelled = sample.where("y >= 0")
    n, n1 = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    counted = (labelled.select("text", "y").mapInArrow(_count, "feature long, many double, inside double")
               .groupBy("feature").agg(F.sum("many").alias("many"), F.sum("inside").alias("inside"))
               .where(F.col("inside") > 0.6 * F.col("many")).collect())  # of TOKEN_WIDTH features at most
    many, inside = np.zeros(TOKEN_WIDTH), np.zeros(TOKEN_WIDTH)
    for f, m, i in counted:
        many[f], inside[f] = m, i
    z = telling(many, inside, n, n1)
    mined = np.argsort(-z, kind="stable")[:min(MINED_TOKENS, int((z > 0).sum()))]
    wanted = np.union1d(np.flatnonzero(z > 0), [_word_id(w) for w in LEXICON])
    featured = sample.select("key", "y", "text").mapInArrow(_featured(wanted, mined), "key string, y int, features array<int>, fired array<int>")
    return fit_in_task(featured, train)


def load(raw: bytes) -> tuple[np.ndarray, float, np.ndarray]:
    got = np.load(io.BytesIO(raw))
    return got["w"], float(got["b"]), tokens_in(got["w"] != 0)


def score(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, name: str = "score") -> DataFrame:
    """``docs`` with the toxicity score (0 to 1) of every text.

    ``labels(doc_id, toxic)``; ``learn`` (a condition on ``doc_id``) limits what is learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = bounded(known, sample)
    rest = docs.select("doc_id").where("doc_id is not null").join(known, "doc_id", "left_anti").distinct()
    chosen = known.union(bounded(rest, sample).withColumn("y", F.lit(-1)))
    raw = fitted(docs, chosen) if known.limit(1).count() else None
    name = fresh(docs, name)
    if raw is None:
        return docs.withColumn(name, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(load(raw))
    return score_texts(docs, sent, _score, "double", pa.float64(), name)


def _score(model, _col, data, off):
    return sigmoid(token_scores(data, off, model[0], model[2]) + model[1])


def drop_toxic(docs: DataFrame, labels: DataFrame, learn: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold; columns as in ``docs``."""
    name = fresh(docs, "_toxicity")
    return score(docs, labels, learn, name=name).where(F.col(name) < threshold).select(*docs.columns)
