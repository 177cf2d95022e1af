"""Operator 1: BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each distinct word; one vectorised
check of all adjacent pairs verifies the proposals; only words with an
incompatible pair are merged exactly. Words are remembered per Python worker
(the memory is emptied when full, which changes no result)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytebpe import ByteBPE, Interned, code_points, gather, load, word_starts
from .shared import add_columns, documents, kept_in_worker

#: Distinct words remembered per Python worker, and bytes of them.
REMEMBERED, REMEMBERED_BYTES = 500_000, 32 << 20

#: Words of more bytes are proposed and merged one by one, not side by side.
LONG = 40


class Encoder:
    """Texts to ids and back, for one vocabulary."""

    def __init__(self, tables: ByteBPE):
        self.tables = tables
        self.merged_exactly = 0
        self._forget()

    def _forget(self) -> None:
        self.words, self.bytes = Interned(), 0
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.at, self.len = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _learn(self) -> None:
        """Ids of the words met for the first time: propose, verify, merge the
        failing ones."""
        new = self.words.new
        if not new:
            return
        self.words.new = []
        raw = [w.encode() for w in new]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.bytes += int(length.sum())
        for some in (np.flatnonzero(length <= LONG), np.flatnonzero(length > LONG)):
            if len(some):
                ids, size = self._tokens([raw[i] for i in some], length[some])
                if self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat[:self.used], np.empty(
                        max(len(self.flat), 2 * len(ids)), np.int32)])
                self.flat[self.used:self.used + len(ids)] = ids
                at, n = self._place(len(self.words))
                own = some + len(self.words) - len(new)
                at[own], n[own] = self.used + np.cumsum(size) - size, size
                self.used += len(ids)

    def _place(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.at):
            more = np.zeros(max(n, 2 * len(self.at)) - len(self.at), np.int64)
            self.at, self.len = np.append(self.at, more), np.append(self.len, more)
        return self.at, self.len

    def _tokens(self, raw: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.tables
        flat, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length
        if length[0] <= LONG:
            ids, size = t.greedy(flat, at, length)
        else:
            guess = [t.greedy_one(w) for w in raw]
            size = np.fromiter(map(len, guess), np.int64, len(guess))
            ids = np.fromiter((i for g in guess for i in g), np.int64, int(size.sum()))
        word = np.repeat(np.arange(len(raw)), size)
        seam = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(ids[seam] * t.size + ids[seam + 1], return_inverse=True)
        good = t.compatible(pairs // t.size, pairs % t.size)
        failing = np.zeros(len(raw), bool)
        failing[word[seam[~good[back]]]] = True
        wrong = np.flatnonzero(failing)
        self.merged_exactly += len(wrong)
        if len(wrong):
            if length[0] <= LONG:
                right, n = t.exact_many(flat, at[wrong], length[wrong])
            else:
                merged = [t.exact(raw[w]) for w in wrong]
                n = np.fromiter(map(len, merged), np.int64, len(merged))
                right = np.fromiter((i for g in merged for i in g), np.int64, int(n.sum()))
            kept = ~failing[word]
            everything = np.concatenate([ids[kept], right])
            size[wrong] = n
            order = np.argsort(np.concatenate([word[kept], np.repeat(wrong, n)]), kind="stable")
            ids = everything[order]
        return ids, size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        if len(self.words) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self._forget()
        special = any(s in t for s in self.tables.special for t in texts)
        if special:
            cut = [self.tables.pieces_of(t) for t in texts]
            parts = [p for c in cut for p in c if not isinstance(p, int)]
        else:
            parts = texts
        big = "".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(sizes) - sizes
        if big:
            points = code_points(big)
            fresh = np.zeros(len(points), bool)
            fresh[begin[sizes > 0]] = True
            starts = np.flatnonzero(word_starts(points, fresh))
            del points
            edges = starts.tolist()
            edges.append(len(big))
            number = np.fromiter((self.words[big[a:b]] for a, b in zip(edges, edges[1:])),
                                 np.int64, len(starts))
            self._learn()
            size = self.len[number]
            ids = gather(self.flat, self.at[number], size)
            done = np.concatenate([[0], np.cumsum(size)])
            first = np.searchsorted(starts, begin)
            counts = done[np.append(first[1:], len(starts))] - done[first]
        else:
            ids, counts = np.empty(0, np.int32), np.zeros(len(parts), np.int64)
        if special:
            ids, counts = self._with_special(cut, ids, counts)
        return ids, counts

    @staticmethod
    def _with_special(cut, ids, counts):
        ends = np.cumsum(counts)
        out, sizes, k = [], [], 0
        for c in cut:
            n = 0
            for p in c:
                if isinstance(p, int):
                    out.append(np.array([p], np.int32))
                    n += 1
                else:
                    out.append(ids[ends[k] - counts[k]:ends[k]])
                    n += int(counts[k])
                    k += 1
            sizes.append(n)
        return np.concatenate(out) if out else ids[:0], np.array(sizes, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' bytes as text; bytes that are no UTF-8 become U+FFFD."""
        t = self.tables
        if t.special and np.isin(ids, list(t.special.values())).any():
            names = {i: s.encode() for s, i in t.special.items()}
            raw = b"".join(names.get(i) or t.pieces[i] for i in ids.tolist())
        else:
            raw = gather(t.piece_bytes, t.piece_at[ids], t.piece_len[ids]).tobytes()
        return raw.decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    return kept_in_worker(("Encoder", path), lambda: Encoder(load(path)))


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids",
               keep: list[str] | None = None) -> DataFrame:
    """``df`` with the token ids of each whole text (array of int).

    Null and empty texts give an empty array; special strings of the vocabulary
    inside a text give their id, as the library does by default. Repeated rows
    stay. A column named like ``ids`` gives way; other columns stay."""
    def make():
        enc = encoder(path)

        def run(texts):
            flat, counts = enc.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
        return run
    return add_columns(df, text, f"`{ids}` array<int>", make, keep)


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None,
                   with_ids: bool = False) -> DataFrame:
    """``df`` with n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers) and decoded_sha256 (of the decoded text in UTF-8), and the
    ids themselves if wanted. Nulls and empties: no tokens, digests of nothing."""
    def make():
        enc = encoder(path)

        def run(texts):
            flat, counts = enc.encode(texts)
            ends = np.cumsum(counts)
            raw, back = [], []
            for a, b in zip((ends - counts).tolist(), ends.tolist()):
                own = flat[a:b]
                raw.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(enc.decode(own).encode()).hexdigest())
            out = {"n_tokens": counts, "ids_sha256": raw, "decoded_sha256": back}
            if with_ids:
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            return out
        return run
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return add_columns(df, text, fields + (", ids array<int>" if with_ids else ""), make, keep)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids (null and empty arrays: empty text)."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def back(col: pa.Array) -> pa.Array:
        enc = encoder(path)
        return pa.array([enc.decode(np.array(x or [], np.int64)) for x in col.to_pylist()],
                        pa.string())
    return df.withColumn(text, back(ids))


def op1_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded."""
    return bpe_round_trip(documents(spark, sf_dir), vocabulary(), keep=["doc_id"])
