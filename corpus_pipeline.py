"""Training-data pipeline over ``documents``: quality rules, quality classifier,
near duplicates, source mixing, BPE encoding.

Every stage works on all that the stage before kept and its decisions take
effect. Stages are written to the shared folder and read again, so a lost
executor costs tasks, never a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm import bpe, classifier, mixing, ngram_join, rules
from panelkit.llm.shared import documents, labels, written

#: How often a source may be read at most when sources are mixed (each is read
#: whole at least once).
MAX_REPEATS = 1.25


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language
    and source. Null and empty texts go; nulls elsewhere are values."""
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them,
    scores 0.3 or more."""
    return classifier.keep_good(docs, labels(spark, sf_dir), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group linked by a likeness of 0.8 or
    more over five-word shingles."""
    return ngram_join.keep_one(docs, width=5, part=8, whole=10)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in mix order: sources as even as MAX_REPEATS allows, every
    document at least once."""
    return mixing.mixed_documents(docs, max_repeats=MAX_REPEATS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: doc_id, source, n_tokens, digests of the ids and of
    the text they decode to, and the ids."""
    return bpe.bpe_round_trip(docs, bpe.vocabulary(), keep=["doc_id", "source"], with_ids=True)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier),
          ("near_duplicates", near_duplicates), ("source_mixing", source_mixing),
          ("bpe_encoding", bpe_encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and robust estimates aren't SQL; tests/llm holds every
#: stage against brute force instead.
ORACLE_SQL = None
