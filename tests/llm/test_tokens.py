"""Operators 1, 8 and 10 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelkit.llm import bpe, counts, pfor
from panelkit.llm.shared import documents
from panelkit.session import shared_path

from . import awkward

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SF = "/root/testdata/sf0.001"


def strings(seed: int, many: int):
    rng = random.Random(seed)
    parts = ["a", "b", "'s", "'re", "'", "''", " ", "  ", "\n", "\t", "é", "ñ", "1", "Ⅷ", "!", "?!", "the", "ing",
             "漢字", "🎉", "　", "Ᲊ", "\U00010d40", "á", "'ll'd", "<|endoftext|>", "  the", "\x85", "\x1c",
             "aaaaaa", "----", "Σ", "İ", "ﬁ", "é", " ́", ".", ",", "<|startoftext|>"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(many)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x2FF),
                                    rng.randrange(0x370, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)]))
                    for _ in range(120)) for _ in range(many // 8)]
    return out + ["", "a" * 3000, " " * 2000 + "x", "".join(rng.choice("abcdeth") for _ in range(9000))]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def test_encoding_and_decoding_equal_the_library(library):
    texts = strings(1, 3000)
    enc = bpe.Encoder(bpe.load(BYTE))
    for i in range(0, len(texts), 200):
        part = texts[i:i + 200]
        ids, n = enc.encode(part)
        for own, ref in zip(np.split(ids, np.cumsum(n)[:-1]), library.encode_batch(part, add_special_tokens=False)):
            assert own.tolist() == ref.ids
            assert enc.decode(own) == library.decode(ref.ids, skip_special_tokens=False)
    assert 0 < enc.merged_exactly < len(enc.words)


def test_ids_that_are_no_text(library):
    enc = bpe.encoder(BYTE)
    ids = np.array([127, 50256, 200, 64, 255], np.int64)
    assert enc.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_pair_check_is_the_same_alone_and_in_bulk():
    t = bpe.load(BYTE)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50256, (2, 3000))
    a, b = np.append(a, np.arange(256, 1500)), np.append(b, t.right[np.arange(256, 1500)])
    assert t.compatible(a, b).tolist() == [t.compatible_one(int(x), int(y)) for x, y in zip(a, b)]


def test_counts_equal_the_library(library):
    texts = strings(2, 2000)
    machine = counts.Transducer(bpe.load(BYTE))
    got = [n for i in range(0, len(texts), 200) for n in machine.count(texts[i:i + 200])]
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_state_maps_of_chunks_inside_words_compose(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeth") for _ in range(40_000)), "a" * 20_001, "ha" * 9000, " " * 7000]
    machine = counts.Transducer(bpe.load(BYTE))
    assert machine.count(texts).tolist() == [
        len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_prefix_scan_over_partial_maps():
    # chunks 1..3 follow the constant chunk 0, which leaves state 7
    maps = [{0: (1, 0), 7: (2, 0)}, {2: (5, 0)}, {0: (9, 0), 5: (6, 0)}]
    assert counts.entry_states(maps, np.array([1, 2, 3]), np.array([7, 0, 0, 0])).tolist() == [7, 2, 5]
    maps[1] = {0: (5, 0)}
    assert counts.entry_states(maps, np.array([1, 2, 3]), np.array([7, 0, 0, 0])).tolist() == [7, -1, -1]


def test_full_table_of_states_is_compiled_afresh(monkeypatch, library):
    monkeypatch.setattr(counts, "STATES", 50)
    machine, texts = counts.Transducer(bpe.load(BYTE)), strings(4, 200)
    got = [machine.count([t])[0] for t in texts]
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_awkward_tables(spark, library):
    df = awkward.table(spark)
    rows = bpe.bpe_round_trip(df, BYTE, with_ids=True).collect()
    assert len(rows) == df.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["score"] == "x"
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.bpe_decode(bpe.bpe_encode(df, BYTE), BYTE)
    assert all(r["decoded"] == (r["text"] or "") for r in back.select("text", "decoded").collect())
    for r in counts.token_counts(df, BYTE, 100).collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 100)
    nothing = awkward.empty(spark)
    assert bpe.bpe_round_trip(nothing, BYTE).count() == counts.token_counts(nothing, BYTE, 1).count() == 0


def test_blocks_round_trip_with_outliers():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 511, 512, 513, 5000):
        for high in (1, 2, 300, 50_000, 2**32 - 1):
            a = rng.integers(0, high, n, dtype=np.uint32)
            a[rng.random(n) < 0.02] = rng.integers(0, 2**32 - 1)
            data = pfor.encode_file(a)
            assert (pfor.decode_file(data) == a).all()
            assert (pfor.decode_file(data, 3, 600) == a[3:600]).all()
    small = np.tile(np.arange(100, 116, dtype=np.uint32), 64)
    small[::97] = 1 << 30
    assert len(pfor.encode_file(small)) < len(small)  # 4 bits an id and a few exceptions
    with pytest.raises(ValueError):
        pfor.decode_file(b"something else")


def test_runs_equal_whole_texts():
    library, enc = Tokenizer.from_file(WORD), pfor.RunEncoder(WORD)
    texts = strings(5, 2000)
    for i in range(0, len(texts), 200):
        part = texts[i:i + 200]
        ids, n = enc.encode(part, 2)
        for own, ref in zip(np.split(ids, np.cumsum(n)[:-1]), library.encode_batch(part, add_special_tokens=False)):
            assert own.tolist() == [*ref.ids, 2]


def test_letters_compose_with_marks_before_they_are_lower_cased():
    library, enc = Tokenizer.from_file(WORD), pfor.RunEncoder(WORD)
    marks = [chr(c) for c in range(0x300, 0x370)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    texts = [f"The {a}{m}. And x{a}{m}y END." for a in letters for m in marks]
    ids, n = enc.encode(texts, 2)
    for text, own, ref in zip(texts, np.split(ids, np.cumsum(n)[:-1]),
                              library.encode_batch(texts, add_special_tokens=False)):
        assert own.tolist() == [*ref.ids, 2], text


def test_words_are_parted_from_signs_and_capitals_of_latin_1_lowered():
    library, enc = Tokenizer.from_file(WORD), pfor.RunEncoder(WORD)
    latin = [chr(c) for c in range(0xC0, 0x100)]
    texts = [f"x{a}{b} {a}{b}y?! {a}{b}{c} A{a}{c}" for a in latin for b in ["", "\u0301", "\u0327", "É", "z"] for c in "!'$|>"]
    texts += [f"so{s}{t} it{s}{t}s <|endoftext|>{s}" for s in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for t in ["", "'", ".", "|>"]]
    ids, n = enc.encode(texts, 2)
    for text, own, ref in zip(texts, np.split(ids, np.cumsum(n)[:-1]),
                              library.encode_batch(texts, add_special_tokens=False)):
        assert own.tolist() == [*ref.ids, 2], text


def test_only_signs_go_through_the_whole_library():
    enc, seen = pfor.RunEncoder(WORD), []

    class Library:
        def encode_batch_fast(self, runs, add_special_tokens):
            seen.extend(runs)
            return library.encode_batch_fast(runs, add_special_tokens=add_special_tokens)

    library, enc.library = enc.library, Library()
    ids, n = enc.encode(["Straße!! Élan.### Noël,%%% ÀÉz good*** ", "good Straße"], 2)
    assert sorted(seen) == ["", "!!", "***", ",%%%", ".###"]
    assert ids.tolist() == [t for x in ("straße!! élan.### noël,%%% àéz good***", "good straße")
                            for t in [*library.encode(x, add_special_tokens=False).ids, 2]]


def test_files_of_an_awkward_table(spark, monkeypatch):
    monkeypatch.setattr(pfor, "FILE_IDS", 200)
    library, df = Tokenizer.from_file(WORD), awkward.table(spark)
    out = shared_path(spark, "tests", f"pfor-{random.random()}")
    pfor.write_ids(df, WORD, out, end=2)
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1,
                   [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in df.collect())
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"])
                 for r in pfor.read_ids(spark, out).collect())
    assert got == want
    start = 0
    rows = pfor.read_digests(spark, out).collect()
    for r, (doc, ids) in zip(sorted(rows, key=lambda r: r["start"]), want):
        # rows of equal doc_id are repeats here, so their order doesn't show
        assert (r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"]) == (doc, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    none = shared_path(spark, "tests", f"pfor-{random.random()}")
    pfor.write_ids(awkward.empty(spark), WORD, none, end=2)
    assert pfor.read_digests(spark, none).count() == 0


def test_queries_over_the_whole_table(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in documents(spark, SF).collect()}
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in docs.items()}
    one = bpe.op1_bpe_round_trip(spark, SF).collect()
    ten = counts.op10_token_counts(spark, SF).collect()
    assert len(one) == len(ten) == len(docs)
    assert all(r["ids_sha256"] == hashlib.sha256(np.array(ids[r["doc_id"]], "<u4").tobytes()).hexdigest() for r in one)
    assert all((r["n_tokens"], r["over_limit"]) == (len(ids[r["doc_id"]]), len(ids[r["doc_id"]]) > 1024) for r in ten)
    word, start = Tokenizer.from_file(WORD), 0
    eight = {r["doc_id"]: r for r in pfor.op8_pfor_files(spark, SF).collect()}
    for d in sorted(docs):
        own = [*word.encode(docs[d], add_special_tokens=False).ids, 2]
        assert (eight[d]["start"], eight[d]["n_tokens"], eight[d]["ids_crc32"]) == (
            start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
