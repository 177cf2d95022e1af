"""Operator 2: quality classifier by supervised subword embeddings.

A document is the average of learned vectors of its hashed words, character
n-grams and repeated-word bigrams; a softmax over two classes reads it. Trained
by numpy stochastic gradient descent on a bounded sample of labelled documents;
the whole text of every document is scored in Arrow passes."""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import add_columns, documents, give_back, labels, packed, unpacked
from .subword import BITS, Features, WordScores, held_out, known, training_sample

FEATURES = Features(3, 4)

#: Vector length, passes, documents a step, step size, and neutral features
#: added to every document (so that a few words don't decide alone).
DIM, EPOCHS, BATCH, RATE, NEUTRAL = 8, 8, 16, 4.0, 60

#: Stands for the word bigram "same word again", whichever the word.
AGAIN = b"\x00again"


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature buckets of each text and their shares."""
    out = []
    for t in texts:
        words = FEATURES.words(t)
        count = Counter(words)
        again = sum(a == b for a, b in zip(words, words[1:]))
        if again:
            count[AGAIN] = again
        bucket, size = FEATURES.of(list(count))
        times = np.repeat(np.fromiter(count.values(), np.float64, len(count)), size)
        ids, back = np.unique(bucket, return_inverse=True)
        share = np.bincount(back, times, len(ids))
        out.append((ids.astype(np.int32), (share / (share.sum() + NEUTRAL)).astype(np.float32)))
    return out


def train(texts: list[str], y: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """(value of each bucket, bias): the log odds of label 1 are the bias plus
    the average value. The two softmax columns collapse to their difference.

    Without examples of both labels nothing is learned: values are 0 and the
    bias is the log odds of the labels seen (0 without any)."""
    buckets = 1 << BITS
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return np.zeros(buckets), prior
    rng = np.random.default_rng(seed)
    bags = _bags(texts)
    vectors = rng.normal(0, 1 / DIM, (buckets, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.array([0, prior], np.float32)
    steps, step = EPOCHS * -(-len(bags) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            own = order[i:i + BATCH]
            rate, step = RATE * (1 - step / steps), step + 1
            ids = np.concatenate([bags[k][0] for k in own])
            share = np.concatenate([bags[k][1] for k in own])
            row = np.repeat(np.arange(len(own)), [len(bags[k][0]) for k in own])
            mean = np.stack([np.bincount(row, vectors[ids, d] * share, len(own))
                             for d in range(DIM)], 1)
            z = mean @ out + bias
            z = np.exp(z - z.max(1, keepdims=True))
            grad = z / z.sum(1, keepdims=True)
            grad[np.arange(len(own)), y[own]] -= 1
            back = grad @ out.T
            out -= rate / len(own) * (mean.T @ grad)
            bias -= rate / len(own) * grad.sum(0)
            seen, at = np.unique(ids, return_inverse=True)
            for d in range(DIM):
                vectors[seen, d] -= rate * np.bincount(at, share * back[row, d], len(seen))
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def score_texts(texts: list[str], words: WordScores, bias: float) -> np.ndarray:
    cut = [FEATURES.words(t) for t in texts]
    size = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = [w for c in cut for w in c]
    flat.append(AGAIN)
    total, n, number = words.of(flat)
    doc = np.repeat(np.arange(len(cut)), size)
    again = doc[1:][(number[:-2] == number[1:-1]) & (doc[1:] == doc[:-1])] if len(doc) else doc
    times = np.bincount(again, minlength=len(cut))
    top = np.bincount(doc, total[:-1], len(cut)) + times * total[-1]
    return 1 / (1 + np.exp(-(bias + top / (np.bincount(doc, n[:-1], len(cut)) + times * n[-1] + NEUTRAL))))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float,
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score and predicted of each whole text. Null and empty
    texts get the bias alone."""
    values, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(values.astype(np.float32))  # 2^BITS numbers

    name = uuid.uuid4().hex

    def make():
        words = known(name, FEATURES, shared.value)

        def run(texts):
            s = score_texts(texts, words, bias)
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}
        return run
    return add_columns(docs, "text", "score double, predicted int", make, keep)


def fit(docs: DataFrame, marks: DataFrame) -> tuple[np.ndarray, float]:
    try:
        return train(*training_sample(docs, marks, "quality"))
    finally:
        give_back()  # the driver lives on and needs nothing of the sample


def keep_good(docs: DataFrame, marks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns."""
    rows = scored(packed(docs, ["text"]), fit(docs, marks), threshold, ["__row", "text"]).where("predicted = 1")
    return unpacked(rows, docs.columns, ["text"])


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, scored for quality."""
    docs = documents(spark, sf_dir)
    out = scored(docs, fit(docs, labels(spark, sf_dir)), 0.3, keep=["doc_id"])
    return held_out(out).select("doc_id", "held_out", "score", "predicted")
