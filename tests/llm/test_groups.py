"""Operators 4, 5, 6 and 7 against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import mixing, ngram_join, packing, sketch
from panelkit.llm.shared import documents, numbered

from . import awkward

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------- shards
def plain_best_fit(sizes, capacity, bins=None):
    """One group at a time, every bin looked at."""
    left = [capacity] * (bins or 0)
    out = []
    for s in sizes:
        fits = [(x, i) for i, x in enumerate(left) if x >= s]
        if fits:
            i = min(fits)[1]
        elif bins is None:
            left.append(max(capacity, s))
            i = len(left) - 1
        else:
            i = max((x, i) for i, x in enumerate(left))[1]
        left[i] -= s
        out.append((s, i))
    return out


@pytest.mark.parametrize("bins", [None, 3, 16])
def test_best_fit_in_bulk_equals_one_by_one(bins):
    rng = random.Random(1)
    for _ in range(60):
        count = collections.Counter(rng.randrange(1, 60) for _ in range(rng.randrange(1, 200)))
        sizes = sorted(count.items(), reverse=True)
        total = sum(s * n for s, n in sizes)
        capacity = -(-total // bins) if bins else 70
        got = collections.Counter()
        for s, a, b, i in packing.best_fit(sizes, capacity, bins):
            got[s, i] += b - a
        assert got == collections.Counter(plain_best_fit([s for s, n in sizes for _ in range(n)], capacity, bins))


def test_capacity_tree_is_a_sorted_list():
    tree, plain, rng = packing.CapacityTree(), [], random.Random(2)
    tree.FULL = 4
    for i in range(2000):
        if plain and rng.random() < 0.45:
            size = rng.randrange(1000)
            want = min((x for x in plain if x[0] >= size), default=None)
            assert tree.take(size) == want
            if want:
                plain.remove(want)
        else:
            plain.append((rng.randrange(1000), i))
            tree.add(*plain[-1])
    assert tree.take_roomiest() == max(plain)


def check_shards(rows, texts):
    shards = collections.defaultdict(int)
    where, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        shards[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(len(w) == 1 for w in where.values())  # equal texts stay together
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(shards.values())
    groups = collections.Counter()
    for t in texts:
        groups[t] += len(t.encode()) + 1
    assert max(shards.values()) <= max(-(-total // 16) + max(map(len, texts)), max(groups.values()))


def test_shards_of_the_whole_table(spark, tmp_path):
    rows = packing.op4_best_fit_shards(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in documents(spark, SF).collect()}
    assert len(rows) == len(docs)
    assert all((r["size"], r["text_crc32"]) == (len(docs[r["doc_id"]].encode()) + 1,
                                                zlib.crc32(docs[r["doc_id"]].encode())) for r in rows)
    check_shards(rows, list(docs.values()))


def test_shards_of_awkward_and_empty_tables(spark, tmp_path):
    awkward.table(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = packing.op4_best_fit_shards(spark, f"{tmp_path}/a").collect()
    texts = [r[1] or "" for r in awkward.rows()]
    assert len(rows) == len(texts)
    check_shards(rows, texts)
    awkward.empty(spark).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert packing.op4_best_fit_shards(spark, f"{tmp_path}/e").count() == 0


def test_fewest_shards_of_fixed_capacity(spark):
    df = spark.createDataFrame([(k, s) for k, s in zip("aabcdefg", (3, 3, 7, 5, 5, 4, 2, 25))], "k string, s long")
    out = packing.pack(df.withColumn("shard", F.lit("old")), "k", "s", capacity=10).collect()
    load = collections.Counter()
    for r in out:
        load[r["shard"]] += r["s"]
    assert sorted(load.values()) == [7 + 2, 6 + 4, 5 + 5, 25]
    assert len({r["shard"] for r in out if r["k"] == "a"}) == 1


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id"))
    out = numbered(df.repartition(7), [F.col("g"), F.col("id").desc()], "t", within=["g"]).collect()
    for g in range(3):
        own = sorted((r["number"], -r["id"]) for r in out if r["g"] == g)
        assert [n for n, _ in own] == list(range(len(own))) and own == sorted(own, key=lambda x: x[1])


# ---------------------------------------------------------------------- mix
def entropy(shares):
    return -sum(p * math.log(p) for p in shares if p)


def sources(spark):
    rng = random.Random(5)
    rows = []
    for s, n in (("big", 300), ("mid", 60), ("small", 20), (None, 9)):
        rows += [(len(rows) + i, awkward.prose(len(rows) + i, rng.randrange(5, 30)), "en", s, 0) for i in range(n)]
    return spark.createDataFrame(rows, awkward.SCHEMA)


def test_bisection_meets_entropy_and_repeats(spark):
    stats = mixing.source_stats(mixing.with_tokens(sources(spark))).cache()
    tokens = [r["tokens"] for r in stats.collect()]
    total = sum(tokens)
    shares = [t / total for t in tokens]
    target = (entropy(shares) + math.log(4)) / 2
    mix = mixing.find_mix(stats, target_entropy=target)
    w = [p ** mix.exponent for p in shares]
    assert abs(entropy([x / sum(w) for x in w]) - target) < 1e-6
    mix = mixing.find_mix(stats, max_repeats=3.0)
    w = [p ** mix.exponent for p in shares]
    reads = [mix.budget * x / sum(w) / t for x, t in zip(w, tokens)]
    assert abs(max(reads) - 3) < 1e-6 and abs(min(reads) - 1) < 1e-9
    with pytest.raises(ValueError):
        mixing.find_mix(stats, max_repeats=1.5, budget=2.0 * total)
    assert mixing.find_mix(stats.limit(0), max_repeats=2.0) is None


def test_mix_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", 7)  # many buckets
    docs = sources(spark)
    sized = mixing.with_tokens(docs).collect()
    for settings in (dict(max_repeats=3.0), dict(target_entropy=1.2, budget=3000.0)):
        rows = mixing.temperature_mix(docs, block_tokens=500, **settings).collect()
        stats = collections.Counter()
        for r in sized:
            stats[r["source"]] += r["n_tokens"]
        mix = mixing.find_mix(mixing.source_stats(mixing.with_tokens(docs)), **settings)
        norm = sum(t ** mix.exponent for t in stats.values())
        blocks = max(1, math.ceil(mix.budget / 500))

        def draw(salt, *parts):
            text = "|".join([salt, *["" if p is None else str(p) for p in parts]])
            return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
        want = []
        for s, whole in stats.items():
            target = mix.budget * whole ** mix.exponent / norm
            for e in range(max(1, math.ceil(target / whole - 1e-6))):
                at = whole * e
                for _, d, n in sorted((draw("mix", s, e, r["doc_id"]), r["doc_id"], r["n_tokens"])
                                      for r in sized if r["source"] == s):
                    if at < target * (1 - 1e-9):
                        b = min(blocks - 1, int(at / target * blocks))
                        want.append((b, draw("mix|block", b, e, d), d, s, e, n))
                    at += n
        want.sort(key=lambda r: r[:3])
        got = sorted(rows, key=lambda r: r["slot"])
        assert [r["slot"] for r in got] == list(range(len(want)))
        assert [(r["block"], r["doc_id"], r["source"], r["epoch"], r["n_tokens"]) for r in got] == [
            (b, d, s, e, n) for b, _, d, s, e, n in want]


@pytest.mark.parametrize("turns", [None, 2])
def test_last_small_documents_of_a_huge_source_are_read(spark, turns):
    sizes = [("hot", 10**11)] * 29 + [("hot", 1)] * 300 + [("cold", 10**10)] * 10
    docs = spark.createDataFrame([(i, s, i, n) for i, (s, n) in enumerate(sizes)],
                                 "doc_id long, source string, tie long, n_tokens long")
    stats = mixing.source_stats(docs)
    # flattest mix with the hot source read once, or all sources exactly twice
    settings = dict(budget=2.0 * sum(n for _, n in sizes)) if turns else dict(max_repeats=2.0)
    rows = mixing.mixed(docs, mixing.find_mix(stats, **settings), stats, block_tokens=1 << 40).collect()
    read = collections.Counter((r["doc_id"], r["epoch"]) for r in rows)
    assert set(read.values()) == {1}
    for epoch in range(turns or 1):
        assert {d for d, e in read if e == epoch} == set(range(len(sizes)))
    assert max(e for _, e in read) == 1


def test_mix_of_awkward_and_empty_tables(spark):
    df = awkward.table(spark)
    rows = mixing.temperature_mix(df, max_repeats=2.0).collect()
    once = collections.Counter(r["doc_id"] for r in rows if r["epoch"] == 0)
    assert once == collections.Counter(r[0] for r in awkward.rows())
    back = mixing.mixed_documents(df, max_repeats=2.0)
    assert back.columns == df.columns
    assert collections.Counter(r["doc_id"] for r in back.collect()) == collections.Counter(r["doc_id"] for r in rows)
    assert mixing.temperature_mix(awkward.empty(spark), max_repeats=2.0).count() == 0
    assert mixing.mixed_documents(awkward.empty(spark), max_repeats=2.0).count() == 0


def test_the_query_reads_every_document(spark):
    rows = mixing.op5_temperature_mixing(spark, SF).collect()
    assert {r["doc_id"] for r in rows if r["epoch"] == 0} == {r["doc_id"] for r in documents(spark, SF).collect()}
    assert max(r["epoch"] for r in rows) <= 1


# --------------------------------------------------------------- n-gram join
def brute_components(rows, width, part, whole):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and whole * common >= part * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted((-1 if d is None else d, len(sets[i]), -1 if least.get(top(i)) is None else least[top(i)])
                  for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in df.collect())


@pytest.mark.parametrize("width, part, whole", [(3, 90, 100), (5, 8, 10), (3, 6, 10)])
def test_components_of_families_equal_brute_force(spark, width, part, whole):
    rng, rows = random.Random(width), []
    for family in range(6):
        base = awkward.prose(family, 60 + 10 * family).split()
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(500)}"
            if rng.random() < 0.2:
                words = words[:-rng.randrange(1, 8)]
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    # a chain: each a little off the one before, the ends far apart
    chain = awkward.prose(77, 80).split()
    for k in range(20):
        chain = [*chain[1:], f"tail{k}"]
        rows.append((5000 - k, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(ngram_join.similar_components(df, width, part, whole)) == brute_components(rows, width, part, whole)


def test_components_of_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    assert found(ngram_join.op6_ngram_jaccard_join(spark, SF)) == brute_components(rows, 3, 90, 100)


def test_components_of_awkward_and_empty_tables(spark):
    rows = [(r[0], r[1]) for r in awkward.rows()]
    df = awkward.table(spark)
    assert found(ngram_join.similar_components(df)) == brute_components(rows, 5, 8, 10)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [
        -1, 1, 2, 3, 4, 6, 7, 9, 10, 12, *range(20, 32)]
    assert ngram_join.similar_components(awkward.empty(spark)).count() == 0


def test_bitmap_lets_all_its_values_through(spark):
    df = spark.range(5000)
    bits = ngram_join.bitmap(df.where("id % 10 = 0"), F.col("id"))
    got = {r["id"] for r in ngram_join.through(df, F.col("id"), bits).collect()}
    assert set(range(0, 5000, 10)) <= got and len(got) < 600


# ------------------------------------------------------------------ sketches
def shingles(text, width=5):
    w = (text or "").encode().split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_edited_texts_and_estimates(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in documents(spark, SF).collect()), reverse=True)
    rows = {r["doc_id"]: r for r in sketch.op7_bottom_k_sketch(spark, SF).collect()}
    assert len(rows) == len(docs)
    off = []
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        m = len(t) // 3
        edited = t[:len(t) - m] + after[:m]
        r = rows[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, got in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = shingles(t), shingles(other)
            off.append(abs(got - (len(a & b) / len(a | b) if a | b else 1.0)))
        if len(shingles(t)) < sketch.K:
            assert r["distinct_shingles"] == len(shingles(t))
    assert sum(off) / len(off) < 0.04 and max(off) < 0.3
    same = collections.defaultdict(set)
    for d, t in docs:
        same[t].add(rows[d]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_merge_containment_and_text_form(spark):
    a, b = awkward.prose(1, 300), awkward.prose(2, 300)
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string")
    s = {c: sketch.sketch(F.col(c)) for c in "abc"}
    r = df.select(sketch.merged(s["a"], s["b"]).alias("m"), s["c"].alias("c"),
                  sketch.containment(s["a"], s["c"]).alias("inside"),
                  sketch.distinct_shingles(s["c"]).alias("n"),
                  (sketch.from_text(sketch.to_text(s["a"])) == s["a"]).alias("same")).first()
    assert len(set(r["m"]) & set(r["c"])) >= sketch.K - 4  # but for the shingles across the seam
    assert r["inside"] > 0.7 and r["same"] and abs(r["n"] - len(shingles(a + " " + b))) < 0.4 * r["n"]


def test_fingerprints_of_awkward_and_empty_tables(spark):
    df = awkward.table(spark)
    rows = sketch.edited_fingerprints(df).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows) == sorted(
        -1 if r[0] is None else r[0] for r in awkward.rows())
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == "" and by[1]["n_chars"] == 0
    assert by[1]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    # descending ids, a null id last, then round to the first
    t, last = awkward.prose(8, 40), awkward.prose(61, 80)
    edited = t[:len(t) - len(t) // 3] + last[:len(t) // 3]
    assert by[None]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert sketch.edited_fingerprints(awkward.empty(spark)).count() == 0
    assert sketch.fingerprints(df).count() == len(rows)


def test_native_operators_run_no_python(spark):
    for query in (mixing.op5_temperature_mixing, sketch.op7_bottom_k_sketch):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_parities_bound_the_difference_of_sets():
    import numpy as np
    rng = np.random.default_rng(0)
    for n, away in ((5, 1), (300, 30), (5000, 900)):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[away:], rng.integers(0, 2**63, away).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        for parts in (ngram_join.PARTS, ngram_join.FINE):
            odd = [np.bincount((s & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1 for s in (a, b)]
            assert (odd[0] ^ odd[1]).sum() <= apart


def test_frequencies_have_no_end():
    n = np.array([0, 1, 2, 10, 60_000, 70_000, 10**6, 10**9, 10**12], np.uint64)
    level = ngram_join.logarithmic(n)
    assert (np.diff(level.astype(int)) > 0).all()


def test_common_ngrams_leave_the_prefix(spark, monkeypatch):
    """Counts far above two bytes still tell a common n-gram from a less common one."""
    monkeypatch.setattr(ngram_join, "CHUNK", 1 << 10)
    docs = spark.createDataFrame([(i, "a b c d e f g") for i in range(20)], "doc_id long, text string")
    grams = ngram_join.ngram_set("a b c d e f g", 3)
    counts = np.zeros((ngram_join.ROWS, 1 << ngram_join.RARITY_BITS), np.uint64)
    times = [10**5, 10**6, 10**7, 10**8, 10**9]
    for r in range(ngram_join.ROWS):
        counts[r][ngram_join._buckets(grams, r)] = times
    counts[0][ngram_join._buckets(grams[:1], 0)] += np.uint64(10**10)  # meets another in one row only
    found = ngram_join.estimate(ngram_join.logarithmic(counts), grams)
    assert (np.argsort(found, kind="stable") == np.arange(5)).all()
    monkeypatch.setattr(ngram_join, "rarity", lambda docs, width: ngram_join.logarithmic(counts))
    keys = ngram_join.prefixes(docs, 3, 8, 10).where("keys is not null").first()["keys"]
    assert list(keys) == [int(g >> np.uint64(16)) for g in grams[:2]]


def test_counts_over_two_bytes_add_up(spark):
    """Tasks count in two bytes and send before one overflows."""
    docs = spark.range(70_000).select(F.lit("a b c").alias("text")).coalesce(1)
    total = ngram_join.rarity(docs, 3)
    (gram,) = ngram_join.ngram_set("a b c", 3).tolist()
    found = ngram_join.estimate(total, np.array([gram], np.uint64))
    assert found[0] == ngram_join.logarithmic(np.array([70_000], np.uint64))[0]
    assert (total > 0).sum() == ngram_join.ROWS


def test_join_equals_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ngram_join.ORACLE)
    names = [d[0] for d in want.description]
    got = ngram_join.op6_ngram_jaccard_join(spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
