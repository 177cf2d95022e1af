"""Operators 2, 3 and 9: brute-force counts and estimates, held-out accuracy."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import classifier, rules, subword, toxicity
from panelkit.llm.shared import documents, labels

from . import awkward

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------------ the rules
def plain_counts(text):
    white = " \t\n\x0b\x0c\r"
    words = "".join(" " if c in white else c for c in text).split(" ")
    words = [w for w in words if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in white for c in line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def plain_estimate(x):
    """Concentration steps on one group's rows, as ``rules.fit`` takes them."""
    floors = np.array(list(rules.FLOORS.values()))
    n = len(x)
    s = np.sort(x, axis=0)
    pick = [s[max(0, math.ceil(q * n) - 1)] for q in (0.25, 0.5, 0.75)]
    mean, inverse = pick[1], np.diag(1 / np.maximum((pick[2] - pick[0]) / 1.349, floors) ** 2)
    factor = rules.consistency(rules.SHARE, x.shape[1])
    for _ in range(rules.STEPS):
        d = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
        bins = np.floor(16 * np.log2(1 + np.maximum(d, 0))).astype(int)
        left, w = math.ceil(n * rules.SHARE), np.zeros(n)
        for b in np.unique(bins):
            own = bins == b
            w[own] = min(1.0, max(0.0, left / own.sum()))
            left -= own.sum()
        mean = (w[:, None] * x).sum(0) / w.sum()
        cov = (w[:, None, None] * x[:, :, None] * x[:, None, :]).sum(0) / w.sum() - np.outer(mean, mean)
        inverse = np.linalg.inv(factor * cov + np.diag(floors ** 2))
    return mean, inverse


def test_counts_of_every_text(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in documents(spark, SF).collect()}
    rows = rules.op3_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == plain_counts(docs[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_verdicts_equal_plain_concentration_steps(spark):
    stats = rules.with_counts(documents(spark, SF), ["doc_id", "lang", "source"]).cache()
    local = stats.toPandas()
    good = local[~local["base_failed"]]
    got = {r["doc_id"]: r for r in rules.judged(stats, rules.fit(stats)).collect()}
    fits = {}

    def estimate(frame, key):
        if key not in fits:
            fits[key] = plain_estimate(frame[rules.X].to_numpy(float))
        return fits[key]
    groups, langs = dict(list(good.groupby(["lang", "source"]))), dict(list(good.groupby("lang")))
    for r in local.itertuples():
        pair = (r.lang, r.source)
        if len(groups.get(pair, ())) >= rules.LEAST_ROWS:
            mean, inverse = estimate(groups[pair], pair)
        elif len(langs.get(r.lang, ())) >= rules.LEAST_ROWS:
            mean, inverse = estimate(langs[r.lang], r.lang)
        else:
            mean, inverse = estimate(good, None)
        x = np.array([getattr(r, c) for c in rules.X]) - mean
        d = float(x @ inverse @ x)
        assert got[r.doc_id]["distance"] == pytest.approx(d, rel=1e-3, abs=1e-3)
        assert got[r.doc_id]["kept"] == (not r.base_failed and d <= rules.CUTOFF)


def test_rules_keep_what_is_labelled_good(spark):
    rows = rules.op3_quality_rules(spark, SF).join(labels(spark, SF), "doc_id").where("not base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert sum(r["kept"] for r in rows if r["quality"] == 0) <= 1


def test_consistency_of_normal_rows():
    x = np.random.default_rng(0).normal(size=(200_000, 5))
    d = (x ** 2).sum(1)
    near = x[d <= np.quantile(d, 0.75)]
    assert 1 / near.var() == pytest.approx(rules.consistency(0.75, 5), rel=0.01)


@pytest.mark.parametrize("share", [0.24, 0.35, 0.45])
def test_junk_of_less_than_half_a_source_does_not_hide_itself(spark, share):
    stats = rules.with_counts(documents(spark, SF), ["doc_id", "lang"]).where("not base_failed")
    local = stats.join(labels(spark, SF), "doc_id").orderBy("doc_id").toPandas()
    rng, many = np.random.default_rng(0), round(600 * share / (1 - share))
    clean = local[(local["lang"] == "en") & (local["quality"] == 1)].sample(600, replace=True, random_state=rng)
    junk = local[local["quality"] == 0].sample(many, replace=True, random_state=rng)
    rows = [("en", "hot", False, int(q), *map(float, x)) for part in (clean, junk)
            for q, x in zip(part["quality"], part[rules.X].to_numpy())]
    df = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, quality int, "
                               + ", ".join(f"{x} double" for x in rules.X))
    got = collections.Counter((r["quality"], r["kept"]) for r in rules.judged(df, rules.fit(df)).collect())
    assert got == {(1, True): 600, (0, False): many}


def test_the_tightest_start_goes_on(spark):
    def row(group, start, log_det):
        return (2, "en", group, start, 100, log_det, *[float(start)] * (len(rules.X) + len(rules.PAIRS)))
    model = spark.createDataFrame([row("a", 0, -20.0), row("a", 1, -21.0), row("a", 2, -27.0),
                                   row("b", 0, -27.0), row("b", 1, -27.1), row(None, 0, -27.0), row(None, 3, -28.0)],
                                  rules._MODEL)
    got = {r["g_source"]: r for r in rules._tightest(model).collect()}
    assert {k: (r["start"], r["m_x_lines"]) for k, r in got.items()} == {"a": (2, 2.0), "b": (0, 0.0), None: (3, 3.0)}


def test_rules_on_awkward_and_empty_tables(spark):
    df = awkward.table(spark)
    for r in rules.quality_rules(df).collect():
        assert r["kept"] is not None and r["base_failed"] is not None
    kept = rules.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [
        -1, 4, 4, 5, 6, *range(20, 32)]
    assert {r["kept"] for r in kept.collect()} == {"x"}  # its own column, not the verdict
    assert rules.quality_rules(awkward.empty(spark)).count() == rules.keep_good(awkward.empty(spark)).count() == 0
    long = "a b c d e f g h i j " * 3000
    assert tuple(rules.counts([long])[k][0] for k in ("n_words", "n_repeat_words")) == (30_000, 30_000)


# ------------------------------------------------------------ the classifiers
def plain_features(word, least, most):
    """The buckets of one word, byte by byte."""
    from xxhash import xxh3_64_intdigest
    mask, marked = (1 << 64) - 1, b"<" + word + b">"
    out = [xxh3_64_intdigest(marked) >> (64 - subword.BITS)]
    for i in range(len(marked)):
        code = 0x9E3779B97F4A7C15
        for n, b in enumerate(marked[i:i + most], 1):
            code = ((code ^ b) * 0x100000001B3) & mask
            if n >= least:
                out.append((((code ^ (code >> 32)) * 0xD6E8FEB86659FD93) & mask) >> (64 - subword.BITS))
    return sorted(out)


def test_features_of_words():
    words = [b"a", b"naive", "café".encode(), b"x" * 300, b"naive"]
    bucket, size = subword.Features(3, 4).of(words)
    for w, own in zip(words, np.split(bucket, np.cumsum(size)[:-1])):
        assert sorted(own.tolist()) == plain_features(w, 3, 4)


def accuracy(spark, rows, label):
    rows = rows.join(labels(spark, SF), "doc_id").where("held_out").collect()
    return np.mean([r["predicted"] == r[label] for r in rows]), rows


def test_held_out_quality(spark):
    rows = classifier.op2_quality_classifier(spark, SF)
    assert rows.count() == documents(spark, SF).count()
    share, held = accuracy(spark, rows, "quality")
    assert len(held) > 50 and share >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in held)


def test_held_out_toxicity(spark):
    share, held = accuracy(spark, toxicity.op9_toxicity(spark, SF), "toxic")
    assert share >= 0.92
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in held)


def test_no_held_out_row_is_learned_from(spark):
    docs, marks = documents(spark, SF), labels(spark, SF)
    texts, y = subword.training_sample(docs, marks, "toxic", 10_000)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    want = docs.join(marks.where(train), "doc_id").where("length(text) between 1 and 200000")
    assert sorted(texts) == sorted(r["text"] for r in want.collect()) and len(y) == len(texts)
    assert len(subword.training_sample(docs, marks, "toxic", 25)[0]) == 25


def test_identity_terms_do_not_make_a_text_toxic():
    rng = random.Random(0)
    plain = [awkward.prose(i, 30) for i in range(150)]
    # In the labels insults and a group name come together.
    texts = plain + [awkward.prose(500 + i, 20) + rng.choice([" idiot", " moron"]) + " muslims" for i in range(60)]
    model = toxicity.train(texts, np.array([0] * 150 + [1] * 60))
    words = subword.WordScores(toxicity.FEATURES, model[0])
    clean, insult = awkward.prose(900, 25), awkward.prose(901, 25)
    s = toxicity.score_texts([clean, clean + " christians", clean + " muslims", insult + " idiot"], words, model[1])
    assert s[3] > 0.5 > s[2]
    assert abs(s[1] - s[2]) < 0.2 and s[1] < 0.3


def test_one_insult_in_a_very_long_text_counts():
    texts = [awkward.prose(i, 30) + (" idiot" if i % 3 == 0 else "") for i in range(200)]
    model = toxicity.train(texts, np.array([int(i % 3 == 0) for i in range(200)]))
    words = subword.WordScores(toxicity.FEATURES, model[0])
    s = toxicity.score_texts([awkward.prose(1000, 20_000), awkward.prose(1000, 20_000) + " Idiot!"], words, model[1])
    assert s[0] < 0.5 < s[1]


def test_classifiers_on_awkward_and_empty_tables(spark):
    df = awkward.table(spark)
    for module, label in ((classifier, "quality"), (toxicity, "toxic")):
        marks = df.select("doc_id", F.pmod("doc_id", F.lit(2)).cast("int").alias(label))
        for model in (module.fit(df, marks), module.fit(awkward.empty(spark), marks.limit(0))):
            rows = module.scored(df, model, 0.5).collect()
            assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
            empty = {r["score"] for r in rows if not (r["text"] or "").strip()}
            assert len(empty) == 1
        assert module.scored(awkward.empty(spark), model, 0.5).count() == 0
    kept = classifier.keep_good(df, df.select("doc_id", F.lit(1).alias("quality")))
    assert kept.columns == df.columns and kept.count() == df.count()


# ------------------------------------------- scores and steps, one at a time
def bucket_values(features, word, values):
    ids, size = features.of([word])
    return [values[i] for i in ids.tolist()], int(size[0])


def test_quality_score_is_the_average_of_its_features():
    rng = np.random.default_rng(4)
    values, bias = rng.normal(0, 1, 1 << subword.BITS), 0.3
    texts = ["one two two three", "", "a", "b b b b", "Ä ö ö, x" * 3]
    got = classifier.score_texts(texts, subword.WordScores(classifier.FEATURES, values), bias)
    for text, score in zip(texts, got):
        words = text.encode().split()
        total = n = 0.0
        for w in [*words, *[classifier.AGAIN for x, y in zip(words, words[1:]) if x == y]]:
            v, size = bucket_values(classifier.FEATURES, w, values)
            total, n = total + sum(v), n + size
        z = [0.0, bias + total / (n + classifier.NEUTRAL)]  # softmax over the two classes
        assert score == pytest.approx(math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1])), rel=1e-9)


def test_quality_step_is_the_gradient(monkeypatch):
    for name, v in (("EPOCHS", 1), ("BATCH", 100), ("RATE", 2.0)):
        monkeypatch.setattr(classifier, name, v)
    texts, y = ["good fine words here", "bad bad bad", "some other text", "bad junk"], np.array([1, 0, 1, 0])
    value, bias = classifier.train(texts, y, seed=3)
    vectors = np.random.default_rng(3).normal(0, 1 / classifier.DIM, (1 << subword.BITS, classifier.DIM)).astype(np.float32)
    means = []
    for t in texts:
        words = t.encode().split()
        rows, n = np.zeros(classifier.DIM), 0
        for w in [*words, *[classifier.AGAIN for a, b in zip(words, words[1:]) if a == b]]:
            ids, size = classifier.FEATURES.of([w])
            rows, n = rows + vectors[ids].sum(0), n + int(size[0])
        means.append(rows / (n + classifier.NEUTRAL))

    def loss(p):
        out, b = p[:-2].reshape(classifier.DIM, 2), p[-2:]
        z = np.array(means) @ out + b
        return float(np.mean([np.log(np.exp(r).sum()) - r[k] for r, k in zip(z, y)]))
    start = np.zeros(2 * classifier.DIM + 2)  # as many of each label: the prior is 0
    step = 1e-5
    grad = np.array([(loss(start + step * e) - loss(start - step * e)) / (2 * step) for e in np.eye(len(start))])
    end = start - classifier.RATE * grad
    out = end[:-2].reshape(classifier.DIM, 2)
    assert bias == pytest.approx(end[-1] - end[-2], abs=1e-5)
    used = np.unique(np.concatenate([classifier.FEATURES.of(t.encode().split())[0] for t in texts]))
    assert np.allclose(value[used], (vectors @ (out[:, 1] - out[:, 0]))[used], atol=1e-5)


def noisy_or(text, values, bias):
    """1 - the product over distinct words of 1 - p."""
    none = 1.0
    for w in dict.fromkeys(toxicity.FEATURES.words(text)):
        v, size = bucket_values(toxicity.FEATURES, w, values)
        none *= 1 - 1 / (1 + math.exp(-(sum(v) / math.sqrt(size) + bias)))
    return 1 - none


def test_toxicity_score_is_a_noisy_or():
    values = np.random.default_rng(5).normal(0, 2, 1 << subword.BITS)
    texts = ["You idiot, you", "", "harmless words. many of them, here", "!!!", "Ünsinn ünsinn"]
    got = toxicity.score_texts(texts, subword.WordScores(toxicity.FEATURES, values), -5.0)
    assert got.tolist() == pytest.approx([noisy_or(t, values, -5.0) for t in texts], rel=1e-7, abs=1e-12)


def test_toxicity_steps_follow_the_gradient(monkeypatch):
    """Two passes over one batch: the first step from zero, the second where the
    penalty on swapped terms counts."""
    texts, y = ["muslims are awful scum", "nice muslims live here", "scum scum", "a plain sentence"], np.array([1, 0, 1, 0])
    for name, v in (("EPOCHS", 2), ("BATCH", 100), ("RATE", 0.3)):
        monkeypatch.setattr(toxicity, name, v)
    got, bias = toxicity.train(texts, y, seed=1)
    rng = np.random.default_rng(1)
    kinds = [np.array([t.encode() for t in v.split()], object) for v in toxicity.IDENTITY_TERMS.values()]
    swaps = [toxicity.swaps(t, rng, {t: k for k in kinds for t in k}, kinds) for t in texts]
    words = {w for t in texts for w in toxicity.FEATURES.words(t)} | {w for s in swaps for p in s for w in p}
    ids = {w: toxicity.FEATURES.of([w])[0] for w in words}
    used = np.unique(np.concatenate(list(ids.values())))
    place = {b: k for k, b in enumerate(used.tolist())}

    def loss(v):
        def energy(w):
            z = sum(v[place[b]] for b in ids[w].tolist()) / math.sqrt(len(ids[w])) + bias
            return math.log1p(math.exp(z))
        out = 0.0
        for t, k, pairs in zip(texts, y, swaps):
            total = sum(energy(w) for w in dict.fromkeys(toxicity.FEATURES.words(t)))
            out += -math.log(-math.expm1(-total)) if k else total
            out += toxicity.FAIR * sum((energy(a) - energy(b)) ** 2 for a, b in pairs)
        return out
    v, grown = np.zeros(len(used)), np.full(len(used), 1e-8)
    for step in range(2):
        h = 1e-4
        grad = np.array([(loss(v + h * e) - loss(v - h * e)) / (2 * h) for e in np.eye(len(used))]) + toxicity.DECAY * v
        grown += grad * grad
        v = v - toxicity.RATE * (1 - step / 2) * grad / np.sqrt(grown)
    assert np.allclose(got[used], v, atol=2e-3) and np.abs(v).max() > 0.1
