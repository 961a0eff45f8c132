"""Operator 5, mixing sources to target weights with soft domain membership.

A multinomial classifier, fitted on a bounded sample of the labelled table, gives every document
a posterior over domains. The document rates solve a nonnegative least squares problem: the
expected tokens per domain, ``sum(rate * tokens * posterior)``, should equal the targets, with a
tiny pull of every rate towards 1.
It is solved by projected gradient steps with momentum from all ones. A domain's miss counts by the
inverse of its share of the tokens, which makes 1 the largest curvature, however rare a domain is. Each
step is one distributed sum (tokens by domain at the rates and at the looked-ahead rates) over the
narrow table of tokens and posteriors: tasks replay the steps so far, a number a domain each, so no
rates are stored or sent. Steps go on until every total meets its target to ``TOLERANCE``, or the
totals stand where they can't; a target that is missed is logged with the total it gets.

Texts are read once: the scored documents are written with their columns, and the steps read
only the narrow ones.

Defined results: null and word-less texts have 0 tokens and still get a rate; targets are
normalised over the domains that were learned (others are left out); equal rows get equal rates;
without any labelled text or any token all rates are 1; an empty table gives an empty result;
the documents' columns pass through.
"""

from __future__ import annotations

import io
import json
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .linear import TRIGRAM_BITS, bounded, fit_in_task, fit_softmax, fresh, sample_texts, score_texts, softmax, trigram_sample, trigram_scores, trigrams_of
from .textbytes import LOWER_NP, word_spans

#: Labelled rows that the domain classifier is fitted on, at most.
SAMPLE = 6000
#: Steps at most (some ten are usual; stopping here is logged).
STEPS = 200
#: Pull towards 1 beside the domains' curvature of 1.
RIDGE = 1e-9
#: Targets under it are met to within ``TOLERANCE`` of it.
LEAST = 1e-4
#: Part of its target by which a domain's total may miss it.
TOLERANCE = 1e-5
log = logging.getLogger(__name__)


def train(table: pa.Table) -> bytes:
    """Sample (domain, trigram shares) to a packed classifier."""
    domain = np.array(table.column("domain").to_pylist(), object)
    names = sorted(set(domain))
    y = np.array([names.index(d) for d in domain])
    w, b = fit_softmax(trigrams_of(table), y, len(names), 1 << TRIGRAM_BITS, l2=1e-5)
    out = io.BytesIO()
    np.savez(out, w=w, b=b, names=np.frombuffer(json.dumps(names).encode(), np.uint8))
    return out.getvalue()


def load(raw: bytes):
    got = np.load(io.BytesIO(raw))
    return got["w"], got["b"], json.loads(got["names"].tobytes())


def _score(model, _col, data, off):
    p = softmax(trigram_scores(data, off, model[0]) + model[1])
    s, _ = word_spans(LOWER_NP[data], off)
    n = np.bincount(np.searchsorted(off, s, side="right") - 1, minlength=len(off) - 1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists], ["n_tokens", "posterior"])


def replay(p: np.ndarray, slopes: list[list[float]], eta: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates and look-ahead rates of documents with posteriors ``p`` after the given projected steps."""
    rate = ahead = np.ones(len(p))
    k = 1.0
    for g in slopes:
        new = np.maximum(0.0, ahead - eta * (p @ np.asarray(g) + RIDGE * (ahead - 1)))
        k_next = (1 + np.sqrt(1 + 4 * k * k)) / 2
        ahead = new + (k - 1) / k_next * (new - rate)
        rate, k = new, k_next
    return rate, ahead


def _sums(slopes: list[list[float]], eta: float):
    """Per task: tokens by domain at the rates after these steps, and at the looked-ahead rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            t = b.column(0).to_numpy().astype(float)
            p = b.column(1).flatten().to_numpy().reshape(len(t), -1)
            rate, ahead = replay(p, slopes, eta)
            part = np.concatenate([(t * rate) @ p, (t * ahead) @ p])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    return run


def _gather(narrow: DataFrame, slopes: list[list[float]], eta: float) -> np.ndarray:
    rows = narrow.mapInArrow(_sums(slopes, eta), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for k, v in rows:
        out[k] = v
    return out


def solve(narrow: DataFrame, target: np.ndarray, steps: int = STEPS, names: list[str] | None = None) -> tuple[list[list[float]], float]:
    """Projected gradient steps over ``narrow(tokens, posterior)``: the slopes and the step size that
    ``replay`` turns into rates. Targets that the rates miss are logged."""
    k = len(target)
    got = _gather(narrow, [], 1.0)
    if not len(got) or got[:k].sum() <= 0:
        return [], 0.0
    total = got[:k].sum()
    share = got[:k] / total
    pull = np.where(share > 0, 1 / np.maximum(share, 1e-300), 0.0)
    eta = 1 / (1 + RIDGE)
    enough = TOLERANCE * np.maximum(target, LEAST)
    slopes: list[list[float]] = []
    now, ahead, still = share, share, 0
    while len(slopes) < steps:
        if (np.abs(now - target) <= 0.5 * enough).all() or still >= 5:
            break
        slopes.append((pull * (ahead - target)).tolist())
        sums = _gather(narrow, slopes, eta) / total
        still = still + 1 if (np.abs(sums[:k] - now) <= 1e-3 * enough).all() else 0
        now, ahead = sums[:k], sums[k:]
    else:
        log.warning("mixing stopped after %d steps", steps)
    for i in np.flatnonzero(np.abs(now - target) > enough):
        log.warning("mixing misses a target: domain %s gets %.6g of the tokens instead of %.6g", names[i] if names else i, now[i], target[i])
    return slopes, eta


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float], sample: int = SAMPLE, keep: list[str] | None = None,
        name: str = "mix") -> DataFrame:
    """The columns ``keep`` (all by default) and a struct (``n_tokens``, ``posterior``, ``rate``).

    ``domains(doc_id, domain)`` is the labelled table; ``targets``: domain to weight."""
    keep = docs.columns if keep is None else keep
    name = fresh(docs, name)
    known = (domains.where("doc_id is not null and domain is not null")
             .groupBy("doc_id").agg(F.min("domain").alias("domain")))
    raw = fit_in_task(trigram_sample(sample_texts(docs, bounded(known, sample))), train)
    if raw is None:
        n = F.lit(0).cast("long")
        return docs.select(*keep, F.struct(n.alias("n_tokens"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate")).alias(name))
    model = load(raw)
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in model[2]])
    weight = weight / weight.sum() if weight.sum() > 0 else np.full(len(weight), 1 / len(weight))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("n_tokens", pa.int64()), ("posterior", pa.list_(pa.float64()))])
    scored = cut(score_texts(docs, sent, _score, "struct<n_tokens: bigint, posterior: array<double>>", kind, name)
                 .select(*keep, name), "posteriors")
    slopes, eta = solve(scored.select(f"{name}.n_tokens", f"{name}.posterior"), weight, names=model[2])
    rated = _rate(slopes, eta)
    return scored.withColumn(name, F.struct(f"{name}.n_tokens", f"{name}.posterior", rated(f"{name}.posterior").alias("rate")))


def _rate(slopes, eta):
    @F.arrow_udf("double")
    def rate(p: pa.Array) -> pa.Array:
        n = len(p)
        return pa.array(replay(p.flatten().to_numpy().reshape(n, -1), slopes, eta)[0] if n else np.zeros(0))

    return rate
