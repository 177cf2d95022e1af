"""Operator 13 against brute force and its SQL."""
import collections
import random
import re

import pytest

from panelkit.llm import divergence

from . import awkward

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least_docs, top):
    """Rows (text, lang, source) -> the operator's rows."""
    count, in_docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups.add((lang, source))
        count.update((lang, source, t) for t in found)
        in_docs.update((lang, t) for t in set(found))
    kept = collections.defaultdict(set)
    for (lang, t), n in in_docs.items():
        if n >= least_docs:
            kept[lang].add(t)

    def shares(lang, counts):
        n, v = sum(counts[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * v) for t in kept[lang]}
    of = {g: collections.Counter({t: count[*g, t] for t in kept[g[0]]}) for g in groups}
    p = {g: shares(g[0], of[g]) for g in groups}
    q = {lang: shares(lang, sum((of[g] for g in groups if g[0] == lang), collections.Counter())) for lang, _ in groups}
    out = []
    for g in groups:
        pair = [(-sum(abs(p[g][t] - p[o][t]) for t in kept[g[0]]), o[1]) for o in groups if o[0] == g[0] and o != g]
        own = [(q[g[0]][t] - p[g][t], t) for t in kept[g[0]] if of[g][t] > 0 and p[g][t] > q[g[0]][t]]
        for part, items, most in (("pair", pair, None), ("term", own, top)):
            items = sorted(items, key=lambda x: (x[0], x[1].encode()))[:most]
            out += [(*g, part, item, -v, k + 1) for k, (v, item) in enumerate(items)]
    return sorted(out)


def got_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("group_block,term_block", [(1, 1), (2, 3), (16, 8192)])
def test_equals_brute_force(spark, group_block, term_block):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["Alpha", "beta", "ÉTÉ", "été", "x1y", "don't", "Straße", "漢字", "q"]) + rng.choice(["", ",", "7"])
                      for _ in range(rng.randrange(12))), rng.choice(["en", "en", "de", None]),
             rng.choice(["a", "b", "c", "d", "é", None])) for _ in range(200)]
    rows += [("rare word", "fr", "a"), (None, "fr", "b"), ("", "it", "a")]  # groups without kept terms
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = divergence.divergence(df, least_docs=4, top=2, group_block=group_block, term_block=term_block)
    assert got_of(got) == plain(rows, 4, 2)


def test_counts_sent_in_parts_add_up(spark, monkeypatch):
    rows = [("one two two", "en", "a"), ("two three", "en", "b")] * 40
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    got = {(r.source, r.term): (r["count"], r.docs) for r in divergence.term_counts(df).collect()}
    assert got == {("a", None): (0, 40), ("b", None): (0, 40), ("a", "one"): (40, 40), ("a", "two"): (80, 40),
                   ("b", "two"): (40, 40), ("b", "three"): (40, 40)}


def test_terms_of_pieces(monkeypatch):
    text = "Alpha-beta éÉ x" * 40 + "y" * 100
    whole = [t for some in divergence.terms(text.encode()) for t in some]
    monkeypatch.setattr(divergence, "PIECE", 5)
    assert [t for some in divergence.terms(text.encode()) for t in some] == whole
    assert whole == [t.encode() for t in TERM.findall(text.replace("A", "a"))]


def test_shares_of_large_counts(spark):
    rows = [(10**13, 4 * 10**13, 10**9), (0, 0, 1), (10**15, 10**15, 1)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    assert [r[0] for r in df.select(divergence._share("c", "n", "v")).collect()] == [
        1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in rows]


def test_awkward_tables(spark):
    rows = [(r[1], r[2], r[3]) for r in awkward.rows()]
    assert got_of(divergence.divergence(awkward.table(spark), least_docs=2)) == plain(rows, 2, 50)
    assert divergence.divergence(awkward.empty(spark)).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(divergence.ORACLE)
    names = [d[0] for d in want.description]
    got = divergence.op13_source_divergence(spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
