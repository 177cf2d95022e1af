"""Operator 12 against a plain Merkle tree and its SQL."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import merkle

from . import awkward

SF = "/root/testdata/sf0.001"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    out = []
    for row in tree[:-1]:
        if (s := at ^ 1) < len(row):
            out.append((row[s], s < at))
        else:
            out.append(None)
        at //= 2
    return out


def climb(digest, path):
    for s in path:
        digest = h([digest] if s is None else [s[0], digest] if s[1] else [digest, s[0]])
    return digest


def plain(rows, changed):
    """Rows (doc_id, text, lang, source, n_chars) -> what the operator returns."""
    def leaf(r, more=0):
        i, text, lang, source, n = r
        return h([field(i), field(source), field(lang), field(None if n is None else n + more), field(text)])
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = {}, {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        order[lang], trees[lang] = own, levels([leaf(r) for r in own])
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, r in enumerate(order[lang]):
            path = siblings(trees[lang], at) + siblings(top, k)
            folded = climb(leaf(r, 1) if changed(r[0]) else leaf(r), path)
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], h([s[0] for s in path if s]), folded,
                        folded == top[-1][0], [s[0] for s in path if s]))
    return sorted(out, key=repr)


def got_of(df):
    return sorted((tuple(r)[:7] + (list(r.proof),) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 33])
def test_missing_is_the_least_set(n):
    rng = random.Random(n)
    for _ in range(20):
        own = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        got = merkle.missing(np.array(own), n)
        want, known, width, level = set(), set(own), n, 0
        while width > 1:
            for p in known:
                if (s := p ^ 1) < width and s not in known:
                    want.add((level, s))
            known, width, level = {p // 2 for p in known}, (width + 1) // 2, level + 1
        assert set(got) == want and len(got) == len(want)


def changed(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 0


def column():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


@pytest.mark.parametrize("bits,span", [(1, 3), (2, 5), (12, 5000)])
def test_equals_a_plain_tree(spark, bits, span):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b é", "", None]), rng.choice([None, "", "de", "en", "en", "en", "é", "z"]),
             rng.choice(["s", None]), rng.choice([None, i])) for i in rng.sample(range(500), 70)]
    df = spark.createDataFrame(rows, awkward.SCHEMA).repartition(3)
    got = merkle.Manifest(df, column(), bits).prove(span=span, with_proof=True)
    assert got_of(got) == plain(rows, changed)


def test_proofs_of_some_rows_fetch_little(spark):
    rows = [(i, f"t{i}", "en" if i % 5 else "de", "s", i) for i in range(60)]
    m = merkle.Manifest(spark.createDataFrame(rows, awkward.SCHEMA), bits=3)
    some = m.leaves.where("doc_id in (3, 4, 20, 59)")
    got = got_of(m.prove(some, span=16, with_proof=True))
    assert got == [r for r in plain(rows, lambda i: False) if r[0] in (3, 4, 20, 59)]
    assert all(r[6] for r in got)


def test_awkward_tables(spark):
    got = merkle.Manifest(awkward.table(spark), column(), bits=2).prove(span=4, with_proof=True)
    assert got_of(got) == plain(awkward.rows(), changed)
    assert merkle.Manifest(awkward.empty(spark)).prove().count() == 0
    one = spark.createDataFrame([(1, "x", "en", "s", 1)], awkward.SCHEMA)
    r = merkle.Manifest(one).prove().first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h([]) and r.verified


def test_query_equals_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(merkle.ORACLE)
    names = [d[0] for d in want.description]
    got = merkle.op12_merkle_manifest(spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = sorted(map(tuple, got.select(*names).collect()))
    assert rows == sorted(want.fetchall())
    ids = {r[names.index("doc_id")]: r[names.index("verified")] for r in rows}
    assert all(v != changed(i) for i, v in ids.items())
