import random

from pyspark.sql import functions as F

from panelkit.operators import resolve as RS


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def rand_name(rnd, alphabet="abcdeőűáé xyz"):
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40)))


def test_lcs_of_a_batch_matches_dp():
    rnd = random.Random(3)
    pairs = [(rand_name(rnd), rand_name(rnd)) for _ in range(400)]
    pairs += [("a" * 62, "a" * 70), ("ab" * 31, "ba" * 40), ("ab" * 70, "ba" * 90), ("", "a"), ("", "")]
    pairs += [(rand_name(rnd) * 5, rand_name(rnd) * 6) for _ in range(40)]
    a, b = map(list, zip(*pairs))
    assert RS.lcs_lengths(a, b).tolist() == [lcs_dp(x, y) for x, y in pairs]


def _score(a, b):
    if not a or not b:
        return 0
    lsum = len(a) + len(b)
    raw = (1.0 - (lsum - 2.0 * lcs_dp(a, b)) / lsum) * 100.0
    return round(raw)


def test_candidates_are_lossless(spark):
    rnd = random.Random(11)
    base = ["kovacs es tarsa kft", "alfa ipari park", "beta park", "gamma zrt", "delta bt",
            "epszilon ipari park kft", "zeta", "eta theta iota"]
    reg = base + [rand_name(rnd) for _ in range(60)]
    qs = []
    for s in reg:
        t = list(s)
        for _ in range(rnd.randint(0, 4)):
            op = rnd.random()
            i = rnd.randrange(len(t) + 1)
            if op < 0.4 and t:
                del t[min(i, len(t) - 1)]
            elif op < 0.8:
                t.insert(i, rnd.choice("abcxyz "))
            elif t:
                t[min(i, len(t) - 1)] = rnd.choice("pqr")
        qs.append("".join(t))
    q = spark.createDataFrame([(x,) for x in set(qs)], "name string").select(
        RS.clean_sorted("name").alias("qs")).filter(F.length("qs") > 0).distinct()
    r = spark.createDataFrame([(x,) for x in set(reg)], "name string").select(
        RS.clean_sorted("name").alias("rs")).filter(F.length("rs") > 0).distinct()
    ql = [x.qs for x in q.collect()]
    rl = [x.rs for x in r.collect()]
    for t in (70, 85, 90):
        brute = {(a, b) for a in ql for b in rl if _score(a, b) >= t}
        got = {(x.qs, x.rs) for x in RS.score_pairs(RS.candidates(q, r, t))
               .filter(F.col("score") >= t).collect()}
        assert got == brute, t


def test_best_match_and_topk(spark):
    reg = spark.createDataFrame([(1, "Alfa Ipari Park"), (2, "alfa ipari park"), (3, "Beta Park")],
                                "entity_id long, entity_name string")
    q = spark.createDataFrame([(10, "PARK, Alfa Ipari"), (11, "Gamma"), (12, "beta prk")],
                              "query_id long, name string")
    best = {r.query_id: (r.matched_id, r.score) for r in RS.best_match(q, reg, 85).collect()}
    assert best[10] == (1, 100) and best[11] == (None, None) and best[12][0] == 3
    top = RS.top_k_review(q, reg, 70, k=3).collect()
    dec = {r.query_id: r.decision for r in top}
    assert dec == {10: "exact", 11: "new", 12: "review"}
    assert [r.candidate_id for r in top if r.query_id == 10] == [1]  # the winner alone
    answers = spark.createDataFrame([(12, 3)], "query_id long, candidate_id long")
    done = {r.query_id: (r.candidate_id, r.state) for r in RS.apply_decisions(
        RS.top_k_review(q, reg, 70, k=3), answers).collect()}
    assert done == {10: (1, "matched"), 11: (None, "new"), 12: (3, "matched")}
    none = spark.createDataFrame([(12, None)], "query_id long, candidate_id long")
    review = RS.top_k_review(q, reg, 70, k=3)
    assert {r.state for r in RS.apply_decisions(review, none).collect() if r.query_id == 12} == {"new"}
    assert {r.state for r in RS.apply_decisions(review, none.limit(0)).collect() if r.query_id == 12} == {"open"}


def test_resolve_or_register_dense_ids(spark):
    reg = spark.createDataFrame([(5, "alfa park")], "entity_id long, entity_name string")
    q = spark.createDataFrame([(1, "Alfa park"), (2, "zeta"), (3, "beta"), (4, "zeta")],
                              "query_id long, name string")
    res, new = RS.resolve_or_register(q, reg, 90)
    got = {r.query_id: (r.resolved_id, r.is_new) for r in res.collect()}
    assert got == {1: (5, False), 2: (7, True), 3: (6, True), 4: (7, True)}
    assert sorted((r.entity_id, r.entity_name) for r in new.collect()) == [(6, "beta"), (7, "zeta")]


def test_one_id_for_all_spellings_of_a_new_name(spark):
    reg = spark.createDataFrame([(10, "something else")], "entity_id long, entity_name string")
    q = spark.createDataFrame([(1, "Alpha Park"), (2, "ALPHA, PARK"), (3, "Park alpha"), (4, "alpha parkk"),
                               (5, "zeta"), (6, "--"), (7, None)], "query_id long, name string")
    res, new = RS.resolve_or_register(q, reg, 90)
    got = {r.query_id: r.resolved_id for r in res.collect()}
    assert got == {1: 11, 2: 11, 3: 11, 4: 11, 5: 12, 6: None, 7: None}
    assert sorted((r.entity_id, r.entity_name) for r in new.collect()) == [(11, "ALPHA, PARK"), (12, "zeta")]


def test_leaders_equal_one_after_the_other(spark):
    rnd = random.Random(5)
    names = set()
    for base in ("kovacs es tarsa kft", "alfa ipari park", "gamma zrt budapest"):
        for _ in range(25):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t.insert(rnd.randrange(len(t)), rnd.choice("abcx"))
            names.add("".join(t))
    leaders, want = [], {}
    for n in sorted(names):
        best = min(((-_score(n, x), x) for x in leaders if _score(n, x) >= 90), default=None)
        want[n] = best[1] if best else n
        leaders += [] if best else [n]
    df = spark.createDataFrame([(n,) for n in names], "qs string")
    assert {r.qs: r.leader for r in RS.lead_names(df, 90).collect()} == want


def one_after_the_other(pairs):
    before, names = {}, set()
    for q, r in pairs:
        before.setdefault(q, set()).add(r)
        names |= {q, r}
    leads = set()
    for n in sorted(names):
        if not before.get(n, set()) & leads:
            leads.add(n)
    return leads


def test_leading_in_components_and_blocks(spark):
    rnd = random.Random(9)
    pairs = {tuple(sorted(rnd.sample(range(300), 2), reverse=True)) for _ in range(330)}
    pairs = {(f"n{q:04}", f"n{r:04}") for q, r in pairs}
    df = spark.createDataFrame(sorted(pairs), "qs string, rs string")
    want = one_after_the_other(pairs)
    assert {r.qs for r in RS.leading(df).collect()} == want
    assert {r.qs for r in RS.leading(df, task_pairs=20, block_names=30).collect()} == want  # cut into blocks
    assert RS.leading(df.limit(0)).count() == 0


def test_a_long_chain_takes_few_jobs(spark, monkeypatch):
    n = 10_000
    df = spark.range(1, n).selectExpr("format_string('n%06d', id) AS qs", "format_string('n%06d', id - 1) AS rs")
    rounds = []
    checkpoint = type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **k: rounds.append(1) or checkpoint(self, *a, **k))
    got = {r.qs for r in RS.leading(df).collect()}
    assert got == {f"n{i:06}" for i in range(0, n, 2)}
    assert len(rounds) < 30


def test_connected_components(spark):
    from panelkit.operators.graph import connected
    rnd = random.Random(4)
    for _ in range(3):
        edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)]
        root = {x: x for e in edges for x in e}
        while True:
            new = dict(root)
            for a, b in edges:
                new[a] = new[b] = min(new[a], new[b])
            if new == root:
                break
            root = new
        got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_candidates_stay_few_while_names_grow(spark):
    rnd = random.Random(7)
    syl = ["ba", "ko", "ri", "ten", "mo", "sza", "lu", "per", "vik", "dor", "na", "gel", "tu", "fi", "hor"]
    def name():
        return " ".join("".join(rnd.choice(syl) for _ in range(3)) for _ in range(3))
    # names of few syllables, the hard case: segments often agree by chance
    share = {}
    for n in (400, 4000):
        reg = [name() for _ in range(n)]
        r = spark.createDataFrame([(x,) for x in set(reg)], "rs string")
        q = spark.createDataFrame([(x[:-1],) for x in reg[:200]], "qs string").distinct()
        share[n] = RS.candidates(q, r, 90).count() / 200 / n
    assert share[4000] < 0.08 and share[4000] < 1.2 * share[400]


def test_resolving_reads_names_and_registry_once(spark, tmp_path):
    """What queries, registry and keys come from is not read again by later steps."""
    import os
    asked = [(n, n) for n in ("alfa park", "ALFA park", "beta ltd", "beta ltd.", "gamma", "gamma2 zrt")]
    for what, data in (("q", asked), ("r", [(7, "alfa park")])):
        spark.createDataFrame(data, "query_id string, name string" if what == "q" else "entity_id long, entity_name string"
                              ).write.parquet(str(tmp_path / what))
    res, new = RS.resolve_or_register(spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "r")), 90)
    for df in (res, new):
        assert str(tmp_path) not in str(df.inputFiles()) and "parquet" not in df._jdf.queryExecution().executedPlan().toString().lower()
    assert {r.query_id: r.resolved_id for r in res.collect()} == {
        "alfa park": 7, "ALFA park": 7, "beta ltd": 8, "beta ltd.": 8, "gamma": 9, "gamma2 zrt": 10}
    assert sorted(map(tuple, new.collect())) == [(8, "beta ltd"), (9, "gamma"), (10, "gamma2 zrt")]
    assert os.listdir(tmp_path / "q")


def test_new_dictionary_rows_evaluate_the_batch_once(spark):
    n = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b
    batch = spark.range(30).selectExpr("id % 7 AS k").mapInArrow(count, "k long")
    new = RS.new_dictionary_rows(batch, spark.createDataFrame([(0, 1)], "k long, id long"), ["k"], "id", lambda c, last: last)
    assert sorted(map(tuple, new.collect())) == [(k, k + 1) for k in range(1, 7)]
    assert n.value == 30
