"""Operator 8: token ids in patched frame-of-reference files.

A file holds whole documents' ids as blocks of ``BLOCK`` ids. Each block
subtracts its minimum and packs the rest at the width that a percentile of its
values needs; larger values keep their low bits in place and their high parts
in the block's exception list. The file's head indexes the block starts, so a
range of ids is read without the others.

Layout, little-endian: b"PFOR0001", u32 ids, u32 ids a block, u32 blocks, u32
start of each block; a block: u32 minimum, u8 width, u8 zero, u16 exceptions,
packed low bits (least first), u16 places, u32 high parts. Files travel as the
``payload`` column of a Parquet table, so that any store Spark writes to can
hold them and lost tasks leave nothing behind."""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .bytebpe import Interned, byte_letters, gather
from .shared import documents, kept_in_worker, slices

BLOCK, PERCENTILE = 512, 0.95
MAGIC = b"PFOR0001"

#: Ids a file holds about (whole documents, one at least).
FILE_IDS = 1 << 20

#: Characters of text encoded at once: the more, the fewer look-ups of a run.
ENCODED_CHARS = 1 << 22

#: Distinct runs of text whose ids a Python worker remembers, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 700_000, 48 << 20


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2^width as rows of bytes."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(values.astype(f"<u{width // 8}")).view(np.uint8)
    size = 2 if width < 16 else 4
    raw = np.ascontiguousarray(values.astype(f"<u{size}")).view(np.uint8).reshape(-1, size)
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpacked(rows: np.ndarray, width: int, block: int) -> np.ndarray:
    if not width:
        return np.zeros((len(rows), block), np.uint32)
    if width in (8, 16, 32):
        return np.ascontiguousarray(rows).view(f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(rows, axis=1, bitorder="little")[:, :block * width]
    bits = bits.reshape(len(rows), block, width)
    out = np.zeros((len(rows), block), np.uint32)
    for k in range(width):
        out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return out


def encode_file(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """Ids (below 2^32) as one file."""
    n = len(ids)
    blocks = -(-n // block)
    head = MAGIC + np.array([n, block, blocks], "<u4").tobytes()
    if not n:
        return head
    rows = np.full(blocks * block, ids[-1], np.uint32)
    rows[:n] = ids
    rows = rows.reshape(blocks, block)
    least = rows.min(1)
    rows = rows - least[:, None]
    at = min(block - 1, int(np.ceil(percentile * block)) - 1)
    pick = np.partition(rows, at, axis=1)[:, at]
    width = np.frexp(pick.astype(np.float64))[1]  # bits that the picked value needs
    over = rows >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        mask = np.uint32((1 << w) - 1)
        low = _packed(rows[own] & mask, w) if w else np.empty((len(own), 0), np.uint8)
        for i, packed in zip(own.tolist(), low):
            place = np.flatnonzero(over[i])
            body[i] = b"".join((least[i].astype("<u4").tobytes(), bytes((w, 0)),
                                np.uint16(len(place)).astype("<u2").tobytes(), packed.tobytes(),
                                place.astype("<u2").tobytes(),
                                (rows[i, place] >> np.uint32(w)).astype("<u4").tobytes()))
    sizes = np.fromiter(map(len, body), np.int64, blocks)
    starts = len(head) + 4 * blocks + np.cumsum(sizes) - sizes
    return b"".join([head, starts.astype("<u4").tobytes(), *body])


def decode_file(data: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids begin..end of a file (default: all); reads only their blocks."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of this format")
    n, block, blocks = np.frombuffer(data, "<u4", 3, 8).tolist()
    end = n if end is None else min(end, n)
    if begin >= end:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    lo, hi = begin // block, -(-end // block)
    starts = np.frombuffer(data, "<u4", blocks, 20)[lo:hi].astype(np.int64)
    heads = raw[starts[:, None] + np.arange(8)]
    least = np.ascontiguousarray(heads[:, :4]).view("<u4")[:, 0]
    width, patches = heads[:, 4], np.ascontiguousarray(heads[:, 6:]).view("<u2")[:, 0]
    out = np.empty((hi - lo, block), np.uint32)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        size = -(-block * w // 8)
        rows = raw[starts[own][:, None] + 8 + np.arange(size)]
        out[own] = _unpacked(rows, w, block)
        for i in own[patches[own] > 0].tolist():
            k, at = int(patches[i]), int(starts[i]) + 8 + size
            place = np.frombuffer(data, "<u2", k, at)
            out[i, place] |= np.frombuffer(data, "<u4", k, at + 2 * k) << np.uint32(w)
    out += least[:, None]
    return out.ravel()[begin - lo * block:end - lo * block]


#: Signs that end a run after a letter (a-z, or one of Latin-1); those that special
#: strings hold are left. The sign comes first, so that the search runs from sign to sign.
_SIGNS = rb"[!-/:;=?@\[-`{}~]"
_STOP = re.compile(_SIGNS + rb"(?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))" + _SIGNS
                   + rb"*(?=[ \t\n\r\x0b\x0c]|\Z)")

#: Small letters only: a word as it stands, which no normaliser changes.
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

#: A capital that a mark may follow (no letter of Latin-1 is one).
_MARKED = re.compile(rb"[A-Z](?=[\x80-\xc2\xc4-\xff])")

#: A capital of Latin-1 that no mark follows.
_LATIN = re.compile(rb"\xc3[\x80-\x96\x98-\x9e](?![\x80-\xc2\xc4-\xff])")


def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """``x``, or a larger array that begins like it, with room for ``more``."""
    if used + more <= len(x):
        return x
    out = np.empty(max(2 * len(x), used + more), x.dtype)
    out[:used] = x[:used]
    return out


class RunEncoder:
    """Ids of texts by the ``tokenizers`` library, which sees each distinct run
    between ASCII white space once. That is exact for a vocabulary whose
    normaliser lower-cases and whose pre-tokeniser drops white space and parts
    letters from signs: no token, special string, composed character or
    lower-casing reaches across white space, nor from a letter to the signs
    that end its run. So such signs are set apart first, and A-Z and the
    capitals of Latin-1 lower-cased (but beside what could be a special string),
    so that runs repeat more. Only capitals directly before another character
    that is neither ASCII nor of Latin-1 are left to the library, which composes
    before it lower-cases: some letters compose with a mark only when small, and
    a mark that composes with a letter follows it with nothing but marks between.

    Runs of small letters are one word that the normaliser leaves alone: they go
    straight to the library's model, as the letters that stand for their bytes.
    Many go at once; the token that ends in the vocabulary's suffix ends a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.letters = {**dict(enumerate(byte_letters())), 32: " "}
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        vocabulary, suffix = self.library.get_vocab(False), self.library.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[n for t, n in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.runs, self.bytes, self.learnt = Interned(), 0, 0
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.len = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Ids of runs met for the first time."""
        word = np.fromiter((_WORD.fullmatch(w) is not None for w in new), bool, len(new))
        word &= self.last.any()
        own, others = np.flatnonzero(word), np.flatnonzero(~word)
        size = np.zeros(len(new), np.int64)
        parts = [np.empty(0, np.uint32)]
        if len(own):
            # Groups of words, so that no encoding is much larger than the longest word's.
            text = b" ".join([new[k] for k in own.tolist()]).decode("latin-1").translate(self.letters).split(" ")
            text = [" ".join(text[k:k + 1000]) for k in range(0, len(text), 1000)]
            for e in self.words.encode_batch_fast(text, add_special_tokens=False):
                parts.append(np.array(e.ids, np.uint32))
            ids = np.concatenate(parts)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(own):
                raise ValueError("words and their last tokens differ in number")
            size[own], parts = np.diff(ends, prepend=0), [ids]
        for k, e in zip(others.tolist(), self.library.encode_batch_fast(
                [new[k].decode() for k in others.tolist()], add_special_tokens=False)):
            parts.append(np.array(e.ids, np.uint32))
            size[k] = len(parts[-1])
        ids, order = np.concatenate(parts), np.concatenate([own, others])
        at = np.empty(len(new), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        self.flat = _room(self.flat, self.used, len(ids))
        self.at, self.len = (_room(x, self.learnt, len(new)) for x in (self.at, self.len))
        self.flat[self.used:self.used + len(ids)] = ids
        self.at[self.learnt:self.learnt + len(new)] = self.used + at
        self.len[self.learnt:self.learnt + len(new)] = size
        self.used, self.learnt = self.used + len(ids), self.learnt + len(new)
        self.bytes += sum(map(len, new)) + 4 * len(ids)

    @staticmethod
    def _parted(raw: bytes) -> bytes:
        """A text with its runs between white space."""
        if b"<|" not in raw:
            low = raw.lower()
            if not raw.isascii():
                low = bytearray(low)
                for m in _MARKED.finditer(raw):
                    low[m.start()] = raw[m.start()]
                for m in _LATIN.finditer(raw):
                    low[m.start() + 1] += 32
            raw = low
        return _STOP.sub(rb" \g<0>", raw)

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all runs, end to end, and of how many each text has; each
        distinct run is looked up once. Between two white spaces at an end of a
        text stands an empty run, which has no ids."""
        cut = pa.array([self._parted(t.encode()) for t in texts], pa.large_binary()).view(pa.large_string())
        cut = pc.ascii_split_whitespace(cut)
        runs = cut.values.dictionary_encode()
        names = runs.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.runs.__getitem__, names), np.int64, len(names))
        return number[runs.indices.to_numpy()], np.diff(cut.offsets.to_numpy())

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, each text's followed by ``end``, and their numbers."""
        if len(self.runs) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self._forget()
        number, held = self._numbers(texts)
        new, self.runs.new = self.runs.new, []
        if new:
            self._learn(new)
        size = self.len[number]
        ids = gather(self.flat, self.at[number], size)
        done = np.concatenate([[0], np.cumsum(size)])
        ends = done[np.cumsum(held)]
        ids = np.insert(ids, ends, end)
        return ids, np.diff(np.concatenate([[0], ends])) + 1


def run_encoder(path: str) -> RunEncoder:
    return kept_in_worker(("RunEncoder", path), lambda: RunEncoder(path))


FILES = ("part int, seq int, start_in_part long, n_ids long, doc_ids array<long>, "
         "lengths array<long>, payload binary")


def write_ids(df: DataFrame, path: str, out: str, end: int, doc_id: str = "doc_id",
              text: str = "text") -> None:
    """Write the ids of all texts, in ascending doc_id order, to ``out``.

    Range partitions by doc_id, one sorted run of files each: file order is
    (part, seq). Null ids come first; null and empty texts hold only the end
    id; rows with equal ids are ordered by their texts' hash, repeated rows
    stay. Other columns are not read."""
    def files(batches):
        enc, part = run_encoder(path), TaskContext.get().partitionId()
        seq = start = held = 0
        names, lengths, ids = [], [], []

        def flush():
            nonlocal seq, start, held, names, lengths, ids
            flat = np.concatenate(ids)
            row = pa.RecordBatch.from_pylist([dict(
                part=part, seq=seq, start_in_part=start, n_ids=len(flat), doc_ids=names,
                lengths=np.concatenate(lengths).tolist(), payload=encode_file(flat))],
                schema=_files_schema())
            seq, start = seq + 1, start + len(flat)
            names, lengths, ids, held = [], [], [], 0
            return row

        for b in batches:
            texts = b.column(1)
            step = max(1, ENCODED_CHARS * max(1, len(texts)) // max(1, texts.nbytes))
            for at in range(0, b.num_rows, step):
                part_of = [x or "" for x in texts.slice(at, step).to_pylist()]
                own = b.column(0).slice(at, step).to_pylist()
                for lo, hi in slices([len(x) for x in part_of], ENCODED_CHARS):
                    flat, n = enc.encode(part_of[lo:hi], end)
                    ids.append(flat)
                    lengths.append(n)
                    names += own[lo:hi]
                    held += len(flat)
                    if held >= FILE_IDS:
                        yield flush()
        if ids:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                     F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(files, FILES).write.parquet(out))


def _files_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start_in_part", pa.int64()),
                      ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                      ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def file_starts(files: DataFrame) -> DataFrame:
    """``files`` with the number of ids in all files before (one row per written
    partition is summed up and broadcast: as many as write tasks)."""
    part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ids_before"))
    return files.join(F.broadcast(part), "part").withColumn(
        "file_start", F.col("ids_before") + F.col("start_in_part")).drop("ids_before")


def read_digests(spark, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def docs(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = decode_file(r["payload"])
                n = np.array(r["lengths"], np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * e])
                       for a, e in zip((ends - n).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["file_start"] + ends - n),
                     pa.array(n), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])
    files = file_starts(spark.read.parquet(out)).select("file_start", "doc_ids", "lengths", "payload")
    return files.mapInArrow(docs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark, out: str) -> DataFrame:
    """Per document, from the files: doc_id and its ids (the end id last)."""
    def docs(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = decode_file(r["payload"]).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(r["lengths"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
                    names=["doc_id", "ids"])
    return spark.read.parquet(out).select("doc_ids", "lengths", "payload").mapInArrow(
        docs, "doc_id long, ids array<long>")


def op8_pfor_files(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents`` written to files and read back."""
    import public_tokenizers
    out = shared_path(spark, "llm", f"pfor-{uuid.uuid4().hex}")
    write_ids(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), out, end=2)
    return read_digests(spark, out)
