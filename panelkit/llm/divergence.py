"""Operator 13: how far sources of a language stand apart in their words.

Terms are counted in one pass over the texts: tasks sum per (lang, source, term)
and send what they have whenever it reaches a bound, Spark adds it up. Shares are
integers: p = 1 + floor(10^9 (count + 5) / (N + 5 V)) with N the counted kept
terms of the group and V the kept terms of its language.

Distances between groups are partitioned as a cube. The groups of a language are
dealt to blocks of ``GROUPS``, its terms to blocks by hash. A task owns cells
(group block, group block, term block): it gets the two slices of the count
matrix, each replicated to the cells of its row and column, lays them out densely
and sums the differences of all its pairs of groups; partial sums are added up
along the term axis. A cell of two slices has a fixed size whatever the input;
terms that neither slice has are not sent: all of them differ by the same number,
and are counted instead.

The result on pairs has a row for each ordered pair of sources of a language, as
the contract asks; everything before it grows with groups x terms."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, on_workers, written

#: Groups in a block and terms in a block (on average): a cell's two slices are
#: 2 x 16 x 8192 numbers.
GROUPS, TERMS = 16, 8192

#: Bytes of distinct terms that a task holds before it sends its counts.
HOLD = 32 << 20

#: Bytes that a held term takes beside its letters.
ENTRY = 300

#: Documents of a language that a kept term is in, at least; rows of part term.
LEAST_DOCS, TOP = 30, 50

#: Bytes that are no part of a term, as blanks; A-Z as a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Bytes of a text split into terms at once.
PIECE = 1 << 20


def terms(raw: bytes):
    """The terms of a text, in lists of bounded size."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and _FOLD[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(_FOLD).split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, count, docs): occurrences of a term in a group
    and the documents that have it. Every group also has a row of the null term
    with its number of documents."""
    on_workers(docs.sparkSession)

    def rows(groups) -> pa.RecordBatch:
        cols = [[], [], [], [], []]
        for (lang, source), (n, count, in_docs) in groups.items():
            cols[0] += [lang] * (len(count) + 1)
            cols[1] += [source] * (len(count) + 1)
            cols[2] += [None, *[t.decode() for t in count]]
            cols[3] += [0, *count.values()]
            cols[4] += [n, *[in_docs[t] for t in count]]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=["lang", "source", "term", "count", "docs"])

    def run(batches):
        groups = defaultdict(lambda: [0, Counter(), Counter()])
        held = 0
        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                g = groups[lang, source]
                g[0] += 1
                own = set()
                for some in terms(text.encode()):
                    g[1].update(some)
                    own.update(some)
                new = own.difference(g[2])
                g[2].update(own)
                held += sum(map(len, new)) + ENTRY * len(new)
                if held > HOLD:
                    yield rows(groups)
                    groups.clear()
                    held = 0
        if groups:
            yield rows(groups)

    blank = F.lit("")
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("lang", "source", "text")])
    found = found.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, kept: str):
    """p of a count: integers of any size, divided exactly."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 5 as decimal(20,0)))"
                  f" div cast({total} + 5 * {kept} as decimal(20,0))")


class Audit:
    """Counts and shares of the groups of ``docs`` (lang, source, text)."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        counts = written(term_counts(docs), "terms")
        of_term = Window.partitionBy("lang", "term")
        kept = (counts.where("term is not null")
                .withColumns({"in_lang": F.sum("docs").over(of_term), "lang_count": F.sum("count").over(of_term)})
                .where(F.col("in_lang") >= least_docs).drop("docs", "in_lang"))
        kept = written(kept, "kept")
        langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("count").alias("lang_n"))
        sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        # Groups stand in the order of their names; their numbers make the blocks.
        order = Window.partitionBy("lang").orderBy("source")
        groups = counts.where("term is null").select("lang", "source")
        groups = (groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
                  .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "v", "lang_n")])
                  .withColumn("number", F.row_number().over(order) - 1))
        self.groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, _share("0", "n", "v"))), "groups")
        self.cells = kept.join(self.groups, ["lang", "source"]).withColumn("p", _share("count", "n", "v"))

    def distances(self, group_block: int = GROUPS, term_block: int = TERMS) -> DataFrame:
        """Rows (lang, a, b, value) for each ordered pair of groups (their
        numbers): the sum of all differences of their shares."""
        most = self.groups.agg(F.max("v")).first()[0] or 0
        term_blocks = max(1, -(-most // term_block))
        mine = F.expr(f"number div {group_block}").cast("int").alias("block")
        last = self.groups.groupBy("lang").agg(F.expr(f"max(number) div {group_block}").cast("int").alias("last_block"))
        entries = self.cells.select("lang", F.pmod(F.xxhash64("term"), F.lit(term_blocks)).cast("int").alias("k"),
                                    "number", "term", "p", mine)
        # Every cell knows its groups, by a row of the null term each.
        heads = self.groups.where("v > 0").select(
            "lang", F.explode(F.sequence(F.lit(0), F.lit(term_blocks - 1))).alias("k"), "number",
            F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), mine)
        # A group's slice goes to the cells of its row and of its column.
        slices = entries.unionByName(heads).join(last, "lang").withColumn(
            "other", F.explode(F.sequence(F.lit(0), "last_block"))).select(
                "lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "k", "number", "term", "p")
        partial = slices.groupBy("lang", "i", "j", "k").applyInArrow(
            lambda t: cell(t, group_block), "lang string, a int, b int, part long, seen long")
        sums = partial.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
        a, b = ([F.col(c).alias(f"{c}_{s}") for c in ("source", "number", "p0")] for s in "ab")
        pairs = self.groups.select("lang", "v", *a).join(self.groups.select("lang", *b), "lang").where("number_a <> number_b")
        pairs = pairs.join(sums.withColumnRenamed("lang", "l"), F.expr(
            "lang = l and least(number_a, number_b) = a and greatest(number_a, number_b) = b"), "left")
        # Terms that no cell of the pair has seen: none of the two has them.
        rest = "(v - coalesce(seen, 0)) * abs(p0_a - p0_b)"
        return pairs.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"),
                            F.expr(f"case when v = 0 then 0L else coalesce(part, 0) + {rest} end").cast("long").alias("value"))

    def own_terms(self) -> DataFrame:
        """Rows (lang, source, item, value): terms a group has more of than its
        language, by how much."""
        more = self.cells.withColumn("q", _share("lang_count", "lang_n", "v")).where("p > q and count > 0")
        return more.select("lang", "source", F.col("term").alias("item"), F.expr("p - q").cast("long").alias("value"))


def cell(table: pa.Table, group_block: int) -> pa.Table:
    """Partial sums of one cell: for each pair of its groups the differences on
    the terms that any of its groups has."""
    lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
    term = table.column("term").combine_chunks()
    number, p = (table.column(c).to_numpy() for c in ("number", "p"))
    head = np.asarray(term.is_null())
    order = np.argsort(number[head], kind="stable")
    names, p0 = number[head][order], p[head][order]
    coded = term.filter(pa.array(~head)).dictionary_encode()
    wide = len(coded.dictionary)
    share = np.repeat(p0[:, None], wide, axis=1)
    share[np.searchsorted(names, number[~head]), coded.indices.to_numpy()] = p[~head]
    block = names // group_block
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    a, b, part = [], [], []
    for k in left:
        others = right[right > k]
        a += [int(names[k])] * len(others)
        b += names[others].tolist()
        part += np.abs(share[others] - share[k]).sum(axis=1).tolist()
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(([lang] * len(a), a, b, part, [wide] * len(a)), kinds)],
                    names=["lang", "a", "b", "part", "seen"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP,
               group_block: int = GROUPS, term_block: int = TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) over ``docs`` (lang, source,
    text; others are not read). Part ``pair``: every other source of the language
    by distance; part ``term``: the ``top`` terms that the group has more of than
    its language.

    Null texts, languages and sources are empty strings. A group without kept
    terms has the share of a count of 0 for each; a language without kept terms
    has distances of 0 and no rows of part term. Repeated rows count as often as
    they stand there; equal values rank by item."""
    audit = Audit(docs, least_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = audit.distances(group_block, term_block).withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)})
    term = audit.own_terms().withColumns({"part": F.lit("term"), "rank": F.row_number().over(order)}).where(F.col("rank") <= top)
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The sources of each language of ``documents`` against each other and
    against the language."""
    return divergence(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
counts AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(max(v), 0) AS v, coalesce(sum(c), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN counts USING (lang, source)
  GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (g.n + 5 * g.v) AS p
  FROM g JOIN kept ON g.lang = kept.lang
  LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source AND counts.term = kept.term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM counts GROUP BY lang, term)
  JOIN (SELECT lang, sum(c) AS n FROM counts GROUP BY lang) USING (lang) JOIN v USING (lang)),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
own AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term)
  WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM own))
WHERE part = 'pair' OR rank <= 50
"""
