"""Operator 11 against brute force and its SQL."""
import collections
import hashlib
import random

import numpy as np
import pytest

from panelkit.llm import anchors
from panelkit.llm.shared import documents

from . import awkward

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    return "".join(" " if c in WHITE else c for c in text or "").split(" ") if text else []


def plain(rows, window):
    """(doc_id, n_words, n_removed, kept words) for rows (doc_id, text)."""
    cut = [(i, [w for w in words_of(t) if w]) for i, t in rows]
    least = {}
    for i, w in cut:
        if i is not None:
            for k in range(len(w) - window + 1):
                run = tuple(w[k:k + window])
                least[run] = min(least.get(run, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k:k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def got_of(df):
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


@pytest.mark.parametrize("period", range(1, 20))
def test_difference_covers(period):
    cover = anchors.difference_cover(period)
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))
    assert anchors.difference_cover(7) == (0, 1, 3)


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for top in (1, 300, 2**20, 2**40, 2**64 - 1):
        keys = np.sort(rng.integers(0, top, 200, np.uint64, endpoint=True))
        assert (anchors.unpack(anchors.pack(keys)) == keys).all()
    for lo, hi in ((0, 0), (-5, 300), (-2**63, 2**63 - 1), (10**12, 10**12 + 70000)):
        ids = rng.integers(lo, hi, 50, np.int64, endpoint=True)
        assert (anchors.unsmall(anchors.small(ids)) == ids).all()


def test_words_of_pieces(monkeypatch):
    text = "alpha  beta\tgamma\n" * 50 + "x" * 500 + " é漢 end"
    whole = anchors.word_hashes(text.encode())
    monkeypatch.setattr(anchors, "PIECE", 7)
    assert (anchors.word_hashes(text.encode()) == whole).all() and len(whole) == 153


def texts(seed, n, vocabulary=30):
    """Texts with passages lent to others at any place, near the window's length."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(5, 40))] for k in range(12)]
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a:a + rng.randrange(1, 30)]
        out.append((i if rng.random() < 0.95 else None, " ".join(w)))
    out += [(200 + i, t) for i, t in rng.sample([(k, t) for k, (_, t) in enumerate(out)], 8)]  # copies
    return out + [(5, "a b c"), (5, out[7][1])]  # ids that repeat


@pytest.mark.parametrize("window,period", [(13, 7), (5, 3), (4, 4), (6, 1)])
def test_equals_brute_force(spark, window, period):
    rows = texts(window, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = anchors.remove_repeats(df, window, period, with_text=True, chunk_bytes=900)  # many chunks
    assert got_of(got) == collections.Counter(plain(rows, window))


def test_a_family_of_copies_in_many_chunks(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(i, shared if i % 3 else f"u{i} {shared} v{i}") for i in range(300)]
    got = anchors.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=500, with_text=True)
    out = {r.doc_id: (r.n_removed, r.kept) for r in got.collect()}
    assert out[0] == (0, f"u0 {shared} v0") and out[3] == (20, "u3 v3") and out[1] == (20, "")
    assert sum(n for n, _ in out.values()) == 20 * 299


def test_awkward_tables(spark):
    got = anchors.remove_repeats(awkward.table(spark), with_text=True)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    rows = [(r[0], r[1]) for r in awkward.rows()]
    assert got_of(got) == collections.Counter(plain(rows, 13))
    for r in got.collect():
        assert r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()
    assert anchors.remove_repeats(awkward.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        anchors.remove_repeats(awkward.empty(spark), window=5, period=6)


def test_query_equals_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(anchors.ORACLE)
    names = [d[0] for d in want.description]
    got = anchors.op11_substring_dedup(spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_text_is_shuffled_once(spark):
    got = anchors.remove_repeats(documents(spark, SF))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "Join" not in final and final.count("FileScan") == 1 and final.count("ReusedExchange") == 2
