"""Operator 11: removing passages that an earlier document already has.

A window is a run of ``window`` words. Every word covered by a window that also
starts in a document with a smaller doc_id goes.

Windows are not compared one by one. Word positions modulo ``period`` that lie
in a difference cover D are anchors: for any two positions i and j some shift
d < period brings both i + d and j + d to D. Anchors are runs of
window - period + 1 words, so any two equal windows, wherever they start, hold
an equal anchor at the same place, and only windows with an anchor that another
document shares need a look. Those are extended to whole windows and settled by
their hashes: the least doc_id of each.

Documents are dealt to chunks of bounded size by a hash of the row, shuffled
once (later steps reuse that exchange), and speak as a chunk: a chunk sends each
of its anchors (or windows, with the least doc_id) once, sorted, packed into one
row a bucket of hashes. So a passage that millions of documents share is one
entry a chunk in its bucket, and no two documents are ever paired. Rows sent are
at most chunks x buckets or the number of anchors, whichever is less.

Anchors are compared by 48 bits (what meets by chance is thrown out by the
windows), windows by 80 bits."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, on_workers

#: Bytes of text in a chunk and anchors in a bucket, on average.
CHUNK_BYTES, BUCKET_KEYS = 4 << 20, 1 << 20

#: Buckets at least (a power of two).
LEAST_BUCKETS = 64

#: Bytes of a text split into words at once.
PIECE = 1 << 20

WHITE = b" \t\n\x0b\x0c\r"


def difference_cover(period: int) -> tuple[int, ...]:
    """The first of the smallest sets whose differences modulo ``period`` are
    all of 0 .. period - 1."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError("period must be 1 or more")


def pieces(raw: bytes):
    """A text in pieces of about PIECE bytes, cut at white space."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and raw[end] not in WHITE:
            end += 1
        yield raw[at:end]
        at = end


def word_hashes(raw: bytes) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    out = [np.empty(0, np.uint64)]
    for piece in pieces(raw):
        words = piece.split()
        out.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _weights(width: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def run_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the run of ``width`` word hashes that starts at each place."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w = _weights(width, seed)
    return _mixed(reduce(np.add, (words[j:j + n] * w[j] for j in range(width))))


def pack(keys: np.ndarray) -> bytes:
    """Ascending numbers: the first, then differences of four bytes, or of eight
    where one needs it."""
    d = np.diff(keys)
    kind = "<u4" if d.max(initial=0) < 1 << 32 else "<u8"
    return kind[2].encode() + keys[:1].astype("<u8").tobytes() + d.astype(kind).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    d = np.frombuffer(raw, f"<u{raw[:1].decode()}", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 1), d]), dtype=np.uint64)


def small(values: np.ndarray) -> bytes:
    """Numbers as differences from the least, in as few bytes as hold them."""
    least = int(values.min())
    d = (values - least).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(d.max()) < 1 << 8 * w)
    return bytes([width]) + least.to_bytes(8, "little", signed=True) + d.astype(f"<u{width}").tobytes()


def unsmall(raw: bytes) -> np.ndarray:
    d = np.frombuffer(raw, f"<u{raw[0]}", offset=9).astype(np.uint64)
    return (d + np.uint64(int.from_bytes(raw[1:9], "little", signed=True) % (1 << 64))).astype(np.int64)


class Chunk:
    """The documents of a chunk as one run of word hashes."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_pylist()
        self.raw = [(t or "").encode() for t in table.column("text").to_pylist()]
        words = [word_hashes(t) for t in self.raw]
        sizes = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate([np.empty(0, np.uint64), *words])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        # Rows without an id neither remove nor lose anything.
        known = np.repeat(np.array([i is not None for i in self.ids], bool), sizes)
        self.doc = np.repeat(np.array([i if i is not None else 0 for i in self.ids], np.int64), sizes)
        self.left = np.where(known, np.repeat(self.ends, sizes) - np.arange(len(self.words)), 0)
        self.place = np.arange(len(self.words)) - np.repeat(self.starts, sizes)

    def anchors(self, window: int, period: int):
        """Places and 48-bit keys of the anchors."""
        width = window - period + 1
        h = run_hashes(self.words, width)
        at = np.zeros(period, bool)
        at[list(difference_cover(period))] = True
        where = np.flatnonzero((self.left[:len(h)] >= width) & at[self.place[:len(h)] % period])
        return where, h[where] >> np.uint64(16)

    def windows(self, window: int, wanted: np.ndarray | None = None):
        """Places, 64-bit hashes and 16 further bits of windows (those ``wanted``)."""
        h = run_hashes(self.words, window, 1)
        ok = self.left[:len(h)] >= window
        if wanted is not None:
            ok &= wanted[:len(h)]
        where = np.flatnonzero(ok)
        check = run_hashes(self.words, window, 2)[where] >> np.uint64(48)
        return where, h[where], check


def _groups(order: np.ndarray, keys: np.ndarray, check: np.ndarray | None = None):
    """Of sorted keys: the first place of each group, and the group of each place."""
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if check is not None:
        c = check[order]
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _by_bucket(keys: np.ndarray, shift: int):
    """(bucket, from, to) of ascending keys; a key's bucket is its bits from ``shift`` up."""
    bucket = (keys >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        if hi > lo:
            yield int(bucket[lo]), lo, hi


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows)) or [[] for _ in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


_ASK = (["bucket", "chunk", "keys"], [pa.int32(), pa.int64(), pa.binary()])
_TELL = (["bucket", "chunk", "keys", "more", "who"], [pa.int32(), pa.int64(), *[pa.binary()] * 3])


def send_anchors(table: pa.Table, window: int, period: int, bits: int) -> pa.Table:
    """A chunk's distinct anchors, one row a bucket."""
    _, keys = Chunk(table).anchors(window, period)
    keys = np.unique(keys)
    chunk = table.column("chunk")[0].as_py()
    return _table([(b, chunk, pack(keys[lo:hi])) for b, lo, hi in _by_bucket(keys, 48 - bits)], *_ASK)


def shared_anchors(table: pa.Table) -> pa.Table:
    """Of a bucket's anchors those of two chunks or more, back to each chunk."""
    bucket = table.column("bucket")[0].as_py()
    chunks, sent = table.column("chunk").to_pylist(), [unpack(x) for x in table.column("keys").to_pylist()]
    keys = np.concatenate(sent)
    order = np.argsort(keys, kind="stable")
    first, group = _groups(order, keys)
    many = np.empty(len(keys), bool)
    many[order] = (np.diff(first, append=len(keys)) > 1)[group]
    ends = np.cumsum([len(s) for s in sent])
    rows = [(bucket, c, pack(s[many[e - len(s):e]])) for c, s, e in zip(chunks, sent, ends)
            if many[e - len(s):e].any()]
    return _table(rows, *_ASK)


def send_windows(docs: pa.Table, shared: pa.Table, window: int, period: int, bits: int) -> pa.Table:
    """A chunk's distinct windows that hold a shared anchor, with their least
    doc_id, one row a bucket."""
    if not docs.num_rows:
        return _table([], *_TELL)
    c = Chunk(docs)
    where, keys = c.anchors(window, period)
    if not len(keys):
        return _table([], *_TELL)
    order = np.argsort(keys, kind="stable")
    first, group = _groups(order, keys)
    distinct, who = keys[order[first]], c.doc[where[order]]
    meets = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
    if shared.num_rows:
        meets |= np.isin(distinct, np.concatenate([unpack(x) for x in shared.column("keys").to_pylist()]))
    hot = np.zeros(len(c.words) + period, np.int32)
    hot[where[order]] = meets[group]
    total = np.concatenate([[0], np.cumsum(hot)])
    wanted = total[period:period + len(c.words)] > total[:len(c.words)]  # one among the first ``period`` places
    where, h, check = c.windows(window, wanted)
    if not len(h):
        return _table([], *_TELL)
    order = np.argsort(h, kind="stable")
    first, _ = _groups(order, h)
    who = np.minimum.reduceat(c.doc[where[order]], first)
    h, check = h[order[first]], check[order[first]]
    chunk = docs.column("chunk")[0].as_py()
    return _table([(b, chunk, *_window_row(h[lo:hi], check[lo:hi], who[lo:hi]))
                   for b, lo, hi in _by_bucket(h, 64 - bits)], *_TELL)


def _window_row(h: np.ndarray, check: np.ndarray, who: np.ndarray) -> tuple[bytes, bytes, bytes]:
    more = (h & np.uint64(0xFFFF)) << np.uint64(16) | check
    return pack(h >> np.uint64(16)), more.astype("<u4").tobytes(), small(who)


def _window_rows(table: pa.Table):
    """Hashes, further bits and doc_ids of every row of a table of windows."""
    for keys, more, who in zip(*(table.column(c).to_pylist() for c in ("keys", "more", "who"))):
        low = np.frombuffer(more, "<u4").astype(np.uint64)
        yield unpack(keys) << np.uint64(16) | low >> np.uint64(16), low & np.uint64(0xFFFF), unsmall(who)


def first_documents(table: pa.Table) -> pa.Table:
    """Of a bucket's windows those that a smaller doc_id of another chunk has,
    with the least one, back to each chunk."""
    bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
    sent = list(_window_rows(table))
    h, check, who = (np.concatenate(x) for x in zip(*sent))
    order = np.argsort(h, kind="stable")
    if np.any((np.diff(h[order]) == 0) & (np.diff(check[order]) != 0)):
        order = np.lexsort((check, h))
    first, group = _groups(order, h, check)
    least = np.empty(len(h), np.int64)
    least[order] = np.minimum.reduceat(who[order], first)[group]
    ends = np.cumsum([len(s[0]) for s in sent])
    rows = []
    for c, (a, b, w), e in zip(chunks, sent, ends):
        l = least[e - len(a):e]
        if (later := l < w).any():
            rows.append((bucket, c, *_window_row(a[later], b[later], l[later])))
    return _table(rows, *_TELL)


def covered(c: Chunk, told: pa.Table, window: int) -> np.ndarray:
    """Which words of a chunk go."""
    gone = np.zeros(len(c.words) + 1, np.int64)
    where, h, check = c.windows(window)
    if len(h):
        order = np.argsort(h, kind="stable")
        first, group = _groups(order, h)
        least = np.minimum.reduceat(c.doc[where[order]], first)
        distinct, bits = h[order[first]], check[order[first]]
        for a, b, w in _window_rows(told):
            at = np.minimum(np.searchsorted(distinct, a), len(distinct) - 1)
            same = (distinct[at] == a) & (bits[at] == b)
            np.minimum.at(least, at[same], w[same])
        later = where[order[least[group] < c.doc[where[order]]]]
        gone[later] += 1
        gone[later + window] -= 1  # a place is a first or a last one once at most
    return np.cumsum(gone[:-1]) > 0


def settle(docs: pa.Table, told: pa.Table, window: int, with_text: bool) -> pa.Table:
    """Per document of a chunk its counts and what is kept."""
    c = Chunk(docs) if docs.num_rows else None
    gone = covered(c, told, window) if c else None
    out = []
    for i, raw, lo, hi in zip(c.ids, c.raw, c.starts.tolist(), c.ends.tolist()) if c else ():
        kept, digest, parts, at = ~gone[lo:hi], hashlib.sha256(), [], 0
        for piece in pieces(raw):
            words = piece.split()
            keep = kept[at:at + len(words)]
            at += len(words)
            if not keep.all():
                words = compress(words, keep.tolist())
            if text := b" ".join(words):
                parts.append(text)
        for k, part in enumerate(parts):
            digest.update(b" " + part if k else part)
        row = (i, hi - lo, int(hi - lo - kept.sum()), digest.hexdigest())
        out.append((*row, b" ".join(parts).decode()) if with_text else row)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][:5 if with_text else 4]
    return _table(out, names, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][:len(names)])


def remove_repeats(docs: DataFrame, window: int = 13, period: int = 7, with_text: bool = False,
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are not read): doc_id, n_words,
    n_removed, kept_sha256 and, with ``with_text``, the kept words joined by one
    space (``kept``).

    Null and empty texts and texts shorter than a window lose nothing. A null
    doc_id is neither smaller nor larger than another: such rows stay whole and
    remove nothing. Rows that share a doc_id don't remove each other's words.
    ``period`` may be 1 to ``window``."""
    if not 1 <= period <= window:
        raise ValueError("period must be 1 to window")
    on_workers(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    # About a word in six bytes, and an anchor in period / |cover| words.
    keys = size * len(difference_cover(period)) // (6 * period)
    bits = max(LEAST_BUCKETS - 1, keys // BUCKET_KEYS).bit_length()
    # The same rows go to the same chunk whenever they are read.
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", "text")
    by_chunk = dealt.groupBy("chunk")
    ask, tell = "bucket int, chunk long, keys binary", "bucket int, chunk long, keys binary, more binary, who binary"

    sent = by_chunk.applyInArrow(lambda t: send_anchors(t, window, period, bits), ask)
    shared = sent.groupBy("bucket").applyInArrow(lambda t: shared_anchors(t), ask)
    asked = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(
        lambda t, s: send_windows(t, s, window, period, bits), tell)
    told = asked.groupBy("bucket").applyInArrow(lambda t: first_documents(t), tell)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(
        lambda t, s: settle(t, s, window, with_text), out)


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 13 words over ``documents``, anchors of seven words at three
    places of every seven."""
    return remove_repeats(documents(spark, sf_dir))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
runs AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS run FROM starts),
firsts AS (SELECT run, min(doc_id) AS least FROM runs GROUP BY run),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM (
    SELECT doc_id, unnest(range(i, i + 13)) AS p FROM runs JOIN firsts USING (run) WHERE least < doc_id)
  GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN words
              ELSE list_select(words, list_sort(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(places, k)))) END AS words
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(words, ' '), '')) AS kept_sha256
FROM kept
"""
