"""Operator 9: toxicity by a counterfactually regularised classifier.

Each word's hashed subword features give it a log odds z of being toxic; a text
is toxic unless every distinct word in it is not (noisy or), so one insult in a
long text counts and many harmless words don't. While training, identity terms
in labelled sentences are swapped for others of their kind (or put into
sentences that have none) and the change of the sentence's score is penalised,
so that naming a group doesn't make a text toxic."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame

from .bytebpe import gather
from .shared import add_columns, documents, give_back, labels
from .subword import BITS, Features, WordScores, held_out, known, training_sample

# Identity terms by kind; a swap stays within its kind.
IDENTITY_TERMS = {
    "belief": "muslim christian jewish hindu buddhist catholic protestant sikh atheist mormon",
    "people": "muslims christians jews hindus immigrants refugees foreigners africans americans "
              "europeans asians arabs mexicans",
    "origin": "african american european asian arab mexican chinese indian turkish polish black white "
              "latino hispanic",
    "gender": "woman man girl boy wife husband mother father daughter son",
    "genders": "women men girls boys females males",
    "orientation": "gay lesbian straight bisexual queer transgender heterosexual homosexual",
    "condition": "blind deaf disabled autistic old young elderly",
    "de": "muslime christen juden frauen männer ausländer flüchtlinge türken polen deutsche",
    "fr": "musulmans chrétiens juifs femmes hommes étrangers réfugiés arabes africains français",
    "es": "musulmanes cristianos judíos mujeres hombres extranjeros refugiados árabes africanos "
          "españoles",
}


class _Words(Features):
    """Lower-cased words without the marks around them."""

    MARKS = b".,!?;:\"'()[]{}|#$%&*<>-_=+~`/\\"

    def words(self, text: str) -> list[bytes]:
        return [w for x in super().words(text) if (w := x.strip(self.MARKS))]


FEATURES = _Words(4, 7, lower=True)

#: Log odds of a word without evidence, passes, documents a step, step size,
#: pull towards no evidence, weight of the counterfactual penalty.
BIAS, EPOCHS, BATCH, RATE, DECAY, FAIR = -5.0, 6, 8, 0.5, 1e-4, 1.0

#: Labelled documents learned from at most.
SAMPLE = 4000


def swaps(text: str, rng: np.random.Generator, terms: dict[bytes, np.ndarray],
          kinds: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """(term, term in its place) for the identity terms of a text's sentences;
    one made up for a sentence if the text names none."""
    found = []
    for sentence in re.split(r"[.!?\n]+", text):
        for w in FEATURES.words(sentence):
            if w in terms:
                found.append((w, rng.choice(terms[w])))
    if not found:
        kind = kinds[rng.integers(len(kinds))]
        found.append(tuple(rng.choice(kind, 2, replace=False)))
    return found


def train(texts: list[str], y: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """(value of each bucket, bias of a word). Without labels of both kinds
    nothing is learned."""
    value = np.zeros(1 << BITS)
    if len(set(y.tolist())) < 2:
        return value, BIAS
    rng = np.random.default_rng(seed)
    kinds = [np.array([t.encode() for t in v.split()], object) for v in IDENTITY_TERMS.values()]
    terms = {t: k for k in kinds for t in k}
    number: dict[bytes, int] = {}
    docs = [np.array(sorted({number.setdefault(w, len(number)) for w in FEATURES.words(t)}), np.int64)
            for t in texts]
    pairs = [np.array([[number.setdefault(w, len(number)) for w in p]
                       for p in swaps(t, rng, terms, kinds)], np.int64) for t in texts]
    bucket, size = FEATURES.of(list(number))
    at = np.cumsum(size) - size
    grown = np.full(1 << BITS, 1e-8)
    steps, step = EPOCHS * -(-len(docs) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            rate, step = RATE * (1 - step / steps), step + 1
            own = [k for k in order[i:i + BATCH] if len(docs[k])]
            if not own:
                continue
            word = np.concatenate([docs[k] for k in own])
            row = np.repeat(np.arange(len(own)), [len(docs[k]) for k in own])
            swap = np.concatenate([pairs[k] for k in own])
            seen, back = np.unique(np.concatenate([word, swap[:, 0], swap[:, 1]]), return_inverse=True)
            n = size[seen]
            feature, of = gather(bucket, at[seen], n), np.repeat(np.arange(len(seen)), n)
            z = np.bincount(of, value[feature], len(seen)) / np.sqrt(n) + BIAS
            energy, slope = np.logaddexp(0, z), 1 / (1 + np.exp(-z))
            # Noisy or: -log(1 - p) is the sum of the words' energies.
            here = back[:len(word)]
            total = np.bincount(row, energy[here], len(own))
            down = np.where(y[own] == 1, -np.exp(-total) / (-np.expm1(-total) + 1e-9), 1.0)
            grad = np.bincount(here, down[row], len(seen))
            # Penalty: square of a sentence's change when a term is swapped; all
            # its other words cancel.
            a, b = back[len(word):len(word) + len(swap)], back[len(word) + len(swap):]
            change = FAIR * 2 * (energy[a] - energy[b])
            grad += np.bincount(a, change, len(seen)) - np.bincount(b, change, len(seen))
            grad *= slope / np.sqrt(n)
            used, place = np.unique(feature, return_inverse=True)
            g = np.bincount(place, grad[of], len(used)) + DECAY * value[used]
            grown[used] += g * g
            value[used] -= rate * g / np.sqrt(grown[used])
    return value, BIAS


def score_texts(texts: list[str], words: WordScores, bias: float) -> np.ndarray:
    """Probability that a text is toxic; 0 for texts without words."""
    cut = [list(dict.fromkeys(FEATURES.words(t))) for t in texts]
    doc = np.repeat(np.arange(len(cut)), np.fromiter(map(len, cut), np.int64, len(cut)))
    total, n, _ = words.of([w for c in cut for w in c])
    energy = np.logaddexp(0, total / np.sqrt(np.maximum(n, 1)) + bias)
    return -np.expm1(-np.bincount(doc, energy, len(cut)))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5,
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score and predicted of each whole text. Null and empty
    texts score 0; repeated rows stay."""
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
        return train(*training_sample(docs, marks, "toxic", SAMPLE))
    finally:
        give_back()  # the driver lives on and needs nothing of the sample


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, scored for toxicity."""
    docs = documents(spark, sf_dir)
    out = scored(docs, fit(docs, labels(spark, sf_dir)), keep=["doc_id"])
    return held_out(out).select("doc_id", "held_out", "score", "predicted")
