"""Toxicity from confirmed toxic examples and unlabelled text (non-negative positive-unlabelled learning)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import slices, words_of_rows

# The fit sees at most so many confirmed toxic texts and so many unlabelled ones,
# those with the smallest hash of their id.
MAX_POSITIVE = 6_000
MAX_UNLABELLED = 20_000


@dataclass
class ToxicityModel:
    """Logistic weights of words, named by their hash in ascending order."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def _word_sets(docs: DataFrame, text: str) -> DataFrame:
    """The distinct words of each text as a binary array of 64-bit hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            h, bounds = words_of_rows(batch.column(0))
            own = [np.unique(h[a:b]).astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.record_batch([pa.array(own, pa.binary())], names=["words"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(sets, "words binary")


def nnpu_fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 800, rate: float = 0.05, ridge: float = 3e-5
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk ``p R+(P) + max(0, R-(U) - p R-(P))`` with logistic loss.

    Where the estimated risk of the negative class falls below zero, the step
    goes the other way along that part alone, as the estimator demands.
    """
    width = positive.shape[1]
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    p = np.column_stack((positive, np.ones(len(positive)))).astype(np.float32)
    u = np.column_stack((unlabelled, np.ones(len(unlabelled)))).astype(np.float32)
    moment, spread = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gp, gu = p @ theta.astype(np.float32), u @ theta.astype(np.float32)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        of_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        grad = prior * (p.T @ (sp - 1)) / len(p) + of_negative if negative >= 0 else -of_negative
        grad = grad + np.append(ridge * theta[:-1], 0)
        moment = 0.9 * moment + 0.1 * grad
        spread = 0.999 * spread + 0.001 * grad**2
        theta -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    max_words: int = 512,
    min_lift: float = 4.0,
) -> ToxicityModel:
    """Fit on the documents and labels given; the caller leaves out what must not be learnt from.

    Positives are documents labelled 1. Unlabelled text is drawn from all the
    documents, whatever their label. The class prior is the share of 1 among all
    non-null labels. Words are features if they are more frequent among the
    positives than in unlabelled text by ``min_lift`` standard errors, or less.
    Without positives, without documents or without such a word the model scores
    the prior (0.5 without labels).
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    share = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    prior = min(max(share if share is not None else 0.5, 1e-3), 1 - 1e-3)

    def draw(ids: DataFrame, most: int) -> DataFrame:
        # at most ``most`` ids, which is what makes the broadcast below bounded
        return ids.orderBy(F.xxhash64(doc_id), doc_id).limit(most)

    toxic = draw(known.where(F.col(label) == 1).select(doc_id).distinct(), max_positive)
    other = draw(docs.where(F.col(doc_id).isNotNull()).select(doc_id), max_unlabelled).distinct()
    sets = []
    for ids in (toxic, other):
        rows = _word_sets(docs.join(F.broadcast(ids), doc_id, "left_semi"), text).collect()
        # copies of one text would count its rare words over and over
        sets.append([np.frombuffer(own, "<u8") for own in sorted({bytes(r["words"]) for r in rows})])
    empty = ToxicityModel(np.empty(0, np.uint64), np.empty(0), float(np.log(prior / (1 - prior))))
    if not sets[0] or not sets[1]:
        return empty
    words, frequency = [], []
    for own in sets:
        values, counts = np.unique(np.concatenate(own), return_counts=True)
        words.append(values)
        frequency.append(counts / len(own))
    every = np.union1d(*words)
    share_p, share_u = np.zeros(len(every)), np.zeros(len(every))
    share_p[np.searchsorted(every, words[0])] = frequency[0]
    share_u[np.searchsorted(every, words[1])] = frequency[1]
    mean = (share_p * len(sets[0]) + share_u * len(sets[1])) / (len(sets[0]) + len(sets[1]))
    error = np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / len(sets[0]) + 1 / len(sets[1])))
    lift = np.abs(share_p - share_u) / error
    chosen = np.flatnonzero((lift >= min_lift) & (mean * (len(sets[0]) + len(sets[1])) >= 4))
    chosen = np.sort(chosen[np.argsort(-lift[chosen], kind="stable")[:max_words]])
    if not len(chosen):
        return empty
    features = every[chosen]
    design = []
    for own in sets:
        x = np.zeros((len(own), len(features)), np.float32)
        for row, values in enumerate(own):
            at = np.searchsorted(features, values)
            at, values = at[at < len(features)], values[at < len(features)]
            x[row, at[features[at] == values]] = 1
        design.append(x)
    weights, bias = nnpu_fit(design[0], design[1], prior)
    return ToxicityModel(features, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with a column ``output`` from 0 to 1, from all distinct words of each whole text.

    A null or empty text has the score of the bias alone. The text column itself
    is not returned.
    """
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(output, T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            h, bounds = words_of_rows(batch.column(batch.schema.get_field_index("__text")))
            logit = np.full(batch.num_rows, model.bias)
            if len(model.words):
                at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
                hit = np.flatnonzero(model.words[at] == h)
                doc = np.searchsorted(bounds, hit, side="right") - 1
                pair = np.unique(doc * len(model.words) + at[hit])
                logit += np.bincount(pair // len(model.words), model.weights[pair % len(model.words)], batch.num_rows)
            out = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
            yield pa.record_batch([*batch.columns[1:], pa.array(out)], names=schema.names)

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in kept])
    return rows.mapInArrow(rate, schema)


def flagged(score_column: Column, threshold: float = 0.7) -> Column:
    return (score_column >= threshold).cast("int")
