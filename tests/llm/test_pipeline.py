"""The pipeline, stage by stage against brute force on each stage's input."""

import collections
import hashlib

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from panelkit.llm import bpe, classifier, ngram_join, rules, subword, toxicity
from panelkit.llm.shared import documents, labels, written

from . import awkward
from .test_groups import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, library = documents(spark, SF), Tokenizer.from_file(bpe.vocabulary())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "near_duplicates", "source_mixing", "bpe_encoding"]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        before, after = docs.collect(), out.collect()
        if name != "bpe_encoding":
            assert out.columns == docs.columns
        if name == "quality_rules":
            kept = {r["doc_id"] for r in rules.quality_rules(docs).where("kept").collect()}
            assert sorted(r["doc_id"] for r in after) == sorted(kept)
        elif name == "quality_classifier":
            values, bias = classifier.fit(docs, labels(spark, SF))
            s = classifier.score_texts([r["text"] for r in before],
                                       subword.WordScores(classifier.FEATURES, values.astype(np.float32)), bias)
            assert sorted(r["doc_id"] for r in after) == sorted(
                r["doc_id"] for r, x in zip(before, s) if x >= 0.3)
        elif name == "near_duplicates":
            want = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 8, 10)
            assert sorted(r["doc_id"] for r in after) == sorted(d for d, _, c in want if c == d)
        elif name == "source_mixing":
            n = collections.Counter(r["doc_id"] for r in after)
            assert set(n) == {r["doc_id"] for r in before} and max(n.values()) <= 2
            assert {r["doc_id"]: r["text"] for r in after} == {r["doc_id"]: r["text"] for r in before}
        else:
            assert collections.Counter(r["doc_id"] for r in after) == collections.Counter(r["doc_id"] for r in before)
            texts = {r["doc_id"]: r["text"] for r in before}
            for r in after:
                assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
                assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        docs = out
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == sorted(
        (r["doc_id"], r["ids_sha256"]) for r in docs.collect())


def test_stages_on_awkward_and_empty_tables(spark):
    for docs in (awkward.table(spark), awkward.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, SF), name)
            assert name == "bpe_encoding" or out.columns == docs.columns
            docs = out


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}


def test_a_text_goes_to_the_worker_once_and_columns_come_back(spark):
    from panelkit.llm import rules
    from panelkit.llm.shared import add_columns, packed, unpacked
    rows = [(1, "a b", None, "x", 7, 3), (2, None, "en", None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, `a.b` int")
    apart = ["text", "lang", "source"]
    df = rules.with_counts(packed(docs, apart), ["__row", *apart])
    assert [tuple(r) for r in unpacked(df, docs.columns, apart).orderBy("doc_id").collect()] == rows
    got = add_columns(docs, "text", "n int", lambda: lambda texts: {"n": list(map(len, texts))}, ["text", "doc_id"])
    assert got.columns == ["text", "doc_id", "n"]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [("a b", 1, 3), (None, 2, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    sent = next(x for x in plan.splitlines()[::-1] if "Project" in x or "LogicalRDD" in x or "LocalRelation" in x)
    assert sent.count("text#") == 1


def test_rules_drop_what_a_worker_kept():
    from panelkit.llm import rules, shared
    shared._KEPT["other"] = bytearray(1 << 20)
    seen = {}

    class Docs:  # takes the place of a frame: only the task's side is run
        def withColumns(self, _):
            return self

    def run(df, text, fields, make, keep):
        seen["fn"] = make()
        return Docs()
    old, rules.add_columns = rules.add_columns, run
    try:
        rules.with_counts(None)
    except Exception:  # columns need a session; the task's side has run
        pass
    finally:
        rules.add_columns = old
    assert seen["fn"] is rules.counts and not shared._KEPT


def test_training_leaves_the_driver_no_memory(spark, monkeypatch):
    rows = [(i, f"some words of text {i}", i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    for module, label in ((classifier, "quality"), (toxicity, "toxic")):
        done, train = [], module.train
        monkeypatch.setattr(module, "train", lambda *a, train=train: done.append("train") or train(*a))
        monkeypatch.setattr(module, "give_back", lambda: done.append("give back"))
        module.fit(docs.select("doc_id", "text"), docs.select("doc_id", docs["y"].alias(label)))
        assert done == ["train", "give back"]


def test_a_round_of_components_joins_labels_twice(spark, monkeypatch, capsys):
    links = [(i, i + 1) for i in range(20)] + [(100, 50), (100, 70), (71, 70)]
    plans = []

    def seen(df, what):
        if what == "labels":
            df.explain()
            plans.append(capsys.readouterr().out)
        return written(df, what)
    monkeypatch.setattr(ngram_join, "written", seen)
    got = ngram_join.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r["id"]: r["comp"] for r in got} == {
        **dict.fromkeys(range(21), 0), **dict.fromkeys((50, 70, 71, 100), 50)}
    assert len(plans) > 2 and all(p.count("HashJoin") + p.count("SortMergeJoin") == 2 for p in plans[1:])
