"""Hashed word and character n-gram features, shared by the two classifiers.

Models are trained by numpy on a bounded sample of labelled documents and
collapse to one number a feature bucket, so that scoring is a lookup: every
distinct word is hashed once per Python worker."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept_in_worker

#: Feature buckets (power of two): the size of a model, whatever the input.
BITS = 17

#: Bound of the training sample: labelled documents, and characters of one.
SAMPLE_DOCS, SAMPLE_CHARS = 2500, 200_000

#: Distinct words whose features a Python worker remembers, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20


class Features:
    """Distinct words -> feature buckets: the word itself and its character
    n-grams between word marks."""

    def __init__(self, least: int, most: int, lower: bool = False):
        self.least, self.most, self.lower = least, most, lower

    def words(self, text: str) -> list[bytes]:
        raw = text.lower().encode() if self.lower else text.encode()
        return raw.split()

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words end to end, and how many each word has."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        from xxhash import xxh3_64_intdigest
        marked = [b"<" + w + b">" for w in words]
        raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        word = np.repeat(np.arange(len(words)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(raw))  # to the word's end
        code = np.full(len(raw), 0x9E3779B97F4A7C15, np.uint64)
        found = [np.fromiter(map(xxh3_64_intdigest, marked), np.uint64, len(marked))]
        owner = [np.arange(len(words))]
        with np.errstate(over="ignore"):
            for n in range(1, self.most + 1):
                ok = np.flatnonzero(left >= n)
                code[ok] = (code[ok] ^ raw[ok + (n - 1)]) * np.uint64(0x100000001B3)
                if n >= self.least:
                    x = code[ok]
                    found.append((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))
                    owner.append(word[ok])
        bucket = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return bucket[order], np.bincount(owner, minlength=len(words))


class WordScores:
    """Sum of a model's bucket values over each word's features, and how many
    features it has; remembered for distinct words."""

    def __init__(self, features: Features, values: np.ndarray):
        self.features, self.values = features, values
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes = 0
        self.sum, self.size = np.empty(0), np.empty(0)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: the sum, the number of features, and the word's number
        (equal for equal words)."""
        if len(self.number) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            bucket, size = self.features.of(new)
            word = np.repeat(np.arange(len(new)), size)
            self.bytes += sum(map(len, new))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.sum = np.append(self.sum, np.bincount(word, self.values[bucket], len(new)))
            self.size = np.append(self.size, size)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return self.sum[at], self.size[at], at


def known(model: str, features: Features, values: np.ndarray) -> WordScores:
    """The word scores of a model (by name), kept in this Python worker."""
    return kept_in_worker(model, lambda: WordScores(features, values))


def training_sample(docs: DataFrame, labels: DataFrame, label: str,
                    most: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Texts and labels (0 or 1) of at most ``most`` labelled documents whose
    crc32(doc_id as text) mod 5 is not 0: those first in an order by hash.
    Documents with no label, no text or more than SAMPLE_CHARS characters are
    not learned from (they are scored like any other)."""
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(
        train & F.col("y").isin(0, 1)).dropDuplicates(["doc_id"])
    # One bounded draw, then the rows of these few documents.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(rows), "doc_id").where(F.length("text").between(1, SAMPLE_CHARS))
    found = found.select("doc_id", F.xxhash64("doc_id").alias("h"), "text", "y").orderBy(
        "h", "doc_id", "text").limit(most).collect()
    return [r["text"] for r in found], np.array([r["y"] for r in found], np.int64)


def held_out(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
