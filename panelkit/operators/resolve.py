"""Entity-name resolution against a registry.

Score = token-sort similarity: clean both names (what is neither letter nor
digit, underscores included -> space, lower case, trim), sort the tokens, join
with one space, then ``100 * (1 - indel / (la + lb))`` with
``indel = la + lb - 2 * LCS``, rounded half-even to an integer. LCS is the
bit-parallel recurrence, run over all pairs of an Arrow batch at once.

Scale: names are deduplicated on both sides first, and names that are equal
after cleaning are matched by an equi-join. For the rest, a pair that reaches
the threshold is at most D insertions and deletions apart; a registry name cut
into D + 1 segments then has one that stands unchanged in the other name, at a
place shifted by what those operations allow. Candidates come from an equi-join
on (length, segments, number, text), which loses no pair; every candidate is
scored exactly. There is no cross join and no cap.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .graph import connected

# Ship this module's Python helpers by value, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EPS = 1e-9


# ----------------------------------------------------------------- scoring
def clean_sorted(c: str | Column) -> Column:
    """Token-sort processing of a name (NULL stays NULL)."""
    c = F.col(c) if isinstance(c, str) else c
    # every run of non-alphanumerics became one space, so after trim the
    # tokens are non-empty (an empty name gives [""], which joins to "")
    s = F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))
    return F.array_join(F.array_sort(F.split(s, " ")), " ")


def _codes(names: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(names), width), pad, np.int32)
    size = np.fromiter(map(len, names), np.int64, len(names))
    flat = np.frombuffer("".join(names).encode("utf-32-le"), np.int32)
    row = np.repeat(np.arange(len(names)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """LCS length of each pair: the bit-parallel recurrence over 64-bit words,
    one step a character of the longer names, all pairs of a step at once."""
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    words = np.fromiter(((len(x) + 63) // 64 for x in short), np.int64, len(short))
    size = np.fromiter(map(len, long), np.int64, len(long))
    out = np.zeros(len(short), np.int32)
    order = np.lexsort((size, words))
    for at in range(0, len(order), 2048):
        rows = order[at:at + 2048]
        w = int(words[rows].max())
        if not w:
            continue
        x = _codes([short[i] for i in rows], 64 * w, -1)
        y = _codes([long[i] for i in rows], int(size[rows].max()), -2)
        v = np.full((len(rows), w), ~np.uint64(0))
        for j in range(y.shape[1]):
            hit = np.packbits(x == y[:, j:j + 1], axis=1, bitorder="little").view("<u8")
            carry = np.zeros(len(rows), np.uint64)
            for k in range(w):
                m, u = hit[:, k], v[:, k] & hit[:, k]
                total = v[:, k] + u
                over = total < u
                total = total + carry
                over |= total < carry
                v[:, k] = total | (v[:, k] & ~m)
                carry = over.astype(np.uint64)
        out[rows] = np.bitwise_count(~v).sum(1)
    return out


@F.pandas_udf(T.IntegerType())
def lcs_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS length of each pair in an Arrow batch (any length)."""
    return pd.Series(lcs_lengths(a.tolist(), b.tolist()))


def score_expr(la: Column, lb: Column, lcs: Column) -> Column:
    lsum = (la + lb).cast("double")
    raw = (F.lit(1.0) - (lsum - F.lit(2.0) * lcs) / lsum) * F.lit(100.0)
    return F.when(lsum > 0, F.bround(raw, 0)).otherwise(F.lit(0.0)).cast("int")


def score_pairs(pairs: DataFrame, a: str = "qs", b: str = "rs") -> DataFrame:
    """Add ``score`` to a frame of cleaned name pairs."""
    both = pairs.withColumn("_lcs", lcs_batch(F.col(a), F.col(b)))
    return both.withColumn("score", score_expr(F.length(a), F.length(b), F.col("_lcs"))).drop("_lcs")


# ------------------------------------------------------ candidate generation
def _reach(threshold: float) -> float:
    """Least unrounded score / 100 that rounds to the threshold. Below two
    thirds a name could lose all its segments, so every pair would qualify."""
    t = (threshold - 0.5 - _EPS) / 100.0
    if t < 2 / 3:
        raise ValueError("thresholds below 68 leave every pair of names a candidate")
    return t


def _partner_lengths(n: Column, t: float) -> tuple[Column, Column]:
    """Shortest and longest partner of a name of length n."""
    return (F.greatest(F.lit(1), F.ceil(n * F.lit(t / (2 - t)) - F.lit(_EPS))).cast("int"),
            F.floor(n * F.lit((2 - t) / t) + F.lit(_EPS)).cast("int"))


def _apart(a: Column, b: Column, t: float) -> Column:
    """Most insertions and deletions between names of these lengths."""
    return F.floor((a + b) * F.lit(1 - t) + F.lit(_EPS)).cast("int")


def _segments(df: DataFrame) -> DataFrame:
    """One row for each segment ``i`` of a registry name of length ``lr`` cut in
    ``m``: its first place (from 0) and size; the last ones take the rest."""
    df = df.withColumn("i", F.explode(F.expr("sequence(0, m - 1)")))
    return df.withColumns({"first": F.expr("i * (lr div m) + greatest(0, i - (m - lr % m))").cast("int"),
                           "size": F.expr("lr div m + int(i >= m - lr % m)").cast("int")})


def candidates(q: DataFrame, r: DataFrame, threshold: float) -> DataFrame:
    """Distinct cleaned pairs (qs, rs) that can reach ``threshold``.

    ``q``/``r`` hold one distinct non-empty cleaned name per row in ``qs`` /
    ``rs``."""
    t = _reach(threshold)
    low, high = _partner_lengths(F.col("lr"), t)
    reg = r.select("rs", F.length("rs").alias("lr")).withColumn("m", F.explode(F.sequence(
        _apart(F.col("lr"), low, t) + 1, _apart(F.col("lr"), high, t) + 1)))
    reg = _segments(reg).select("rs", "lr", "m", "i", F.expr("substring(rs, first + 1, size)").alias("text"))
    low, high = _partner_lengths(F.col("lq"), t)
    que = q.select("qs", F.length("qs").alias("lq")).where(low <= high)
    que = que.withColumn("lr", F.explode(F.sequence(low, high)))
    que = que.withColumn("d", _apart(F.col("lq"), F.col("lr"), t)).where(F.expr("abs(lq - lr) <= d"))
    que = _segments(que.withColumn("m", F.col("d") + 1))
    que = que.withColumns({
        "from": F.expr("greatest(0, first - (d - (lq - lr)) div 2)").cast("int"),
        "to": F.expr("least(lq - size, first + (d + (lq - lr)) div 2)").cast("int")}).where("from <= to")
    que = que.withColumn("at", F.explode(F.sequence("from", "to"))).select(
        "qs", "lr", "m", "i", F.expr("substring(qs, at + 1, size)").alias("text")).distinct()
    return que.join(reg, ["lr", "m", "i", "text"]).select("qs", "rs").distinct()


# ----------------------------------------------------------------- matching
#: From this length on, names that differ can score 100 after rounding.
LONG_NAME = 99


def _prepare(queries: DataFrame, registry: DataFrame, qid: str, qname: str,
             rid: str, rname: str):
    qc = queries.select(F.col(qid).alias("query_id"), F.col(qname).alias("query_name"),
                        clean_sorted(qname).alias("qs"))
    rc = registry.select(F.col(rid).alias("candidate_id"), F.col(rname).alias("candidate_name"),
                         clean_sorted(rname).alias("rs"))
    uq = qc.select("qs").filter(F.length("qs") > 0).distinct()
    ur = rc.select("rs").filter(F.length("rs") > 0).distinct()
    return qc, rc, uq, ur


def scored_names(queries: DataFrame, registry: DataFrame, threshold: float,
                 qid="query_id", qname="name", rid="entity_id", rname="entity_name"):
    qc, rc, uq, ur = _prepare(queries, registry, qid, qname, rid, rname)
    sc = score_pairs(candidates(uq, ur, threshold)).filter(F.col("score") >= threshold)
    return qc, rc, sc


def best_match(queries: DataFrame, registry: DataFrame, threshold: float = 85,
               qid="query_id", qname="name", rid="entity_id", rname="entity_name") -> DataFrame:
    """Per query row the best registry id with score >= threshold (ties:
    smallest id), else NULL."""
    qc, rc, uq, ur = _prepare(queries, registry, qid, qname, rid, rname)
    # Equal names score 100. Only for long names can another one round to 100
    # too, so the short ones need no other candidates.
    same = uq.join(ur, F.col("qs") == F.col("rs")).withColumn("score", F.lit(100))
    settled = same.where(F.length("qs") < LONG_NAME).select("qs")
    others = candidates(uq.join(settled, "qs", "left_anti"), ur, threshold).where("qs <> rs")
    sc = same.unionByName(score_pairs(others).filter(F.col("score") >= threshold))
    first_id = rc.groupBy("rs").agg(F.min("candidate_id").alias("candidate_id"))
    w = Window.partitionBy("qs").orderBy(F.col("score").desc(), F.col("candidate_id"))
    best = (sc.join(first_id, "rs").withColumn("_rk", F.row_number().over(w))
              .filter(F.col("_rk") == 1).select("qs", "candidate_id", "score"))
    return (qc.join(best, "qs", "left")
              .select("query_id", "query_name", F.col("candidate_id").alias("matched_id"), "score"))


def top_k_review(queries: DataFrame, registry: DataFrame, threshold: float = 70, k: int = 3,
                 qid="query_id", qname="name", rid="entity_id", rname="entity_name") -> DataFrame:
    """J2 + O4: up to ``k`` candidates per query (score desc, id asc) with
    ``decision``: 'exact' (the winner alone) when the best score is 100,
    'review' otherwise, 'new' (one row, no candidate) when nothing reaches the
    threshold."""
    qc, rc, sc = scored_names(queries, registry, threshold, qid, qname, rid, rname)
    wr = Window.partitionBy("rs").orderBy("candidate_id")
    rk_ids = rc.withColumn("_r", F.row_number().over(wr)).filter(F.col("_r") <= k).drop("_r")
    w = Window.partitionBy("qs").orderBy(F.col("score").desc(), F.col("candidate_id"))
    top = (sc.join(rk_ids, "rs").withColumn("rank", F.row_number().over(w))
             .filter(F.col("rank") <= k)
             .withColumn("_best", F.max("score").over(Window.partitionBy("qs")))
             .filter((F.col("_best") < 100) | (F.col("rank") == 1))
             .withColumn("decision", F.when(F.col("_best") == 100, F.lit("exact"))
                         .otherwise(F.lit("review")))
             .select("qs", "candidate_id", "candidate_name", "score", "rank", "decision"))
    out = qc.join(top, "qs", "left")
    return out.select("query_id", "query_name", "candidate_id", "candidate_name", "score",
                      "rank", F.coalesce("decision", F.lit("new")).alias("decision"))


def apply_decisions(review: DataFrame, decisions: DataFrame) -> DataFrame:
    """The answers joined back. ``decisions`` has one row per reviewed
    query_id: candidate_id, the accepted candidate, or NULL for a new name.

    Returns per query_id: query_name, candidate_id and state: 'matched', 'new'
    or 'open' (no answer yet, or one that names none of its candidates)."""
    d = decisions.select("query_id", F.col("candidate_id").alias("accepted"), F.lit(True).alias("answered"))
    rows = review.join(d, "query_id", "left")
    exact, new = F.col("decision") == "exact", F.col("decision") == "new"
    taken = exact | (F.col("answered") & (F.col("accepted") == F.col("candidate_id")))
    out = rows.groupBy("query_id").agg(
        F.first("query_name").alias("query_name"), F.max(F.when(taken, F.col("candidate_id"))).alias("candidate_id"),
        F.max(new | (F.coalesce("answered", F.lit(False)) & F.col("accepted").isNull())).alias("_new"))
    return out.withColumn("state", F.when(F.col("candidate_id").isNotNull(), "matched").when(
        F.col("_new"), "new").otherwise("open")).drop("_new")


#: Pairs of a component, and names of a block of a larger one, that one task solves.
TASK_PAIRS, BLOCK_NAMES = 500_000, 20_000


def _leaders(pairs: pa.Table) -> pa.Table:
    """The sequential rule on the pairs (qs, rs; rs < qs) of one component: names
    in order, each a leader unless a smaller one that it resembles is."""
    before: dict[str, list[str]] = {}
    names = set()
    for q, r in zip(pairs.column("qs").to_pylist(), pairs.column("rs").to_pylist()):
        before.setdefault(q, []).append(r)
        names.add(r)
        names.add(q)
    leads: set[str] = set()
    for n in sorted(names):
        if leads.isdisjoint(before.get(n, ())):
            leads.add(n)
    return pa.table({"qs": pa.array(sorted(leads), pa.string())})


def lead_names(names: DataFrame, threshold: float, task_pairs: int = TASK_PAIRS,
               block_names: int = BLOCK_NAMES) -> DataFrame:
    """Each cleaned name (``qs``) and its ``leader``, as if the names had been
    registered one after the other in order: a name joins the best-scoring
    leader before it (ties: the first) or becomes one itself.

    Only names that resemble each other depend on each other, so the rule is
    solved inside connected components, each in one task. The names of a component
    with more than ``task_pairs`` pairs are cut, in their order, into blocks of
    ``block_names``: a name depends on smaller ones alone, so the blocks of all
    large components are solved one number after the other. The number of jobs
    grows with the logarithm of the longest chain and with the blocks of the
    largest component, not with the names."""
    ensure_checkpoint_dir(names.sparkSession)
    pairs = score_pairs(candidates(names, names.select(F.col("qs").alias("rs")), threshold))
    near = pairs.where((F.col("score") >= threshold) & (F.col("rs") < F.col("qs"))).checkpoint()
    leads = leading(near, task_pairs, block_names)
    alone = names.select("qs").join(near.select("qs").union(near.select("rs")).distinct(), "qs", "left_anti")
    own = leads.union(alone).select("qs", F.col("qs").alias("leader"))
    best = near.join(leads.select(F.col("qs").alias("rs")), "rs", "left_semi").join(leads, "qs", "left_anti")
    best = best.groupBy("qs").agg(F.min(F.struct((-F.col("score")).alias("s"), "rs")).alias("b"))
    return own.union(best.select("qs", F.col("b.rs").alias("leader")))


def leading(near: DataFrame, task_pairs: int = TASK_PAIRS, block_names: int = BLOCK_NAMES) -> DataFrame:
    """The leaders (``qs``) among the names of the pairs ``near`` (qs, rs, rs < qs)."""
    roots = connected(near, "qs", "rs")
    pairs = near.select("qs", "rs").join(roots.withColumnRenamed("node", "qs"), "qs")
    sizes = pairs.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.join(sizes, "root").checkpoint()
    leads = pairs.where(F.col("n") <= task_pairs).select("root", "qs", "rs").groupBy("root").applyInArrow(
        _leaders, "qs string").checkpoint()
    large = pairs.where(F.col("n") > task_pairs).select("root", "qs", "rs")
    if large.isEmpty():
        return leads
    # Places of the names within all large components, in order; a block never
    # holds more than block_names names, of however many components.
    places = roots.join(large.select("root").distinct(), "root", "left_semi")
    places = dense_ids(places, ["root", "node"], 0, "place")
    first = places.groupBy("root").agg(F.min("place").alias("first"))
    blocks = places.join(first, "root").select("node", F.expr(f"(place - first) div {block_names}").alias("block")).checkpoint()
    large = (large.join(blocks.withColumnRenamed("node", "qs"), "qs")
             .join(blocks.select(F.col("node").alias("rs"), F.col("block").alias("r_block")), "rs").checkpoint())
    nodes = places.select("root", "node").join(blocks, "node").checkpoint()
    for b in range(int(nodes.agg(F.max("block")).first()[0]) + 1):
        # Followers of leaders in earlier blocks go; the rest settle among themselves.
        settled = large.where((F.col("block") == b) & (F.col("r_block") < b)).join(
            leads.select(F.col("qs").alias("rs")), "rs", "left_semi").select("qs").distinct()
        open_ = nodes.where(F.col("block") == b).select("root", F.col("node").alias("qs")).join(settled, "qs", "left_anti")
        inner = (large.where((F.col("block") == b) & (F.col("r_block") == b)).select("root", "qs", "rs")
                 .join(open_.select("qs"), "qs", "left_semi")
                 .join(open_.select(F.col("qs").alias("rs")), "rs", "left_semi")).select("root", "qs", "rs").checkpoint()
        free = open_.select("qs").join(inner.select("qs").union(inner.select("rs")).distinct(), "qs", "left_anti")
        now = inner.groupBy("root").applyInArrow(_leaders, "qs string")
        leads = leads.union(now).union(free).checkpoint()
    return leads


def dense_ids(df: DataFrame, order: list[str], start: Column | int, id_col: str = "new_id",
              store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Consecutive ids ``start + 1, start + 2, ...`` in the order of the columns
    without a single-partition window: range-partition and sort, count rows
    per partition (one row per partition), turn counts into offsets, add the
    index within the partition. The sorted frame is checkpointed to the shared
    checkpoint folder so both uses see the same rows after an executor loss.

    ``store`` writes the sorted frame to the shared folder in place of the
    checkpoint, for large frames: as columns, of which the counts read one."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = (ranged.withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mono", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True) if store is None else store(ranged)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a bounded frame, broadcast on purpose
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    start_c = start if isinstance(start, Column) else F.lit(start)
    idx = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (ranged.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
                  .withColumn(id_col, (start_c + F.col("_off") + idx + 1).cast("long"))
                  .drop("_pid", "_mono", "_off"))


def _last_id(known: DataFrame, id_col: str, fresh: DataFrame, claim: Callable[[int, int], int] | None) -> int:
    """The id that new ones are numbered after: the largest known one, or what
    ``claim(how many, largest known)`` gives."""
    last = int(known.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).first()["m"])
    return last if claim is None else claim(fresh.count(), last)


def resolve_or_register(queries: DataFrame, registry: DataFrame, threshold: float = 90,
                        qid="query_id", qname="name", rid="entity_id", rname="entity_name",
                        claim: Callable[[int, int], int] | None = None):
    """Matched id, else a new id, numbered after the registry's largest (or
    after the range that ``claim`` gives) in the order of cleaned names.
    Spellings that are equal after cleaning, or that reach the threshold among
    themselves, share one id; the new entry has the smallest spelling of the
    leading name. Names without a letter or digit stay without an id. Returns
    (resolution per query row, new registry rows).

    Matches and leaders are checkpointed, so ``queries`` and ``registry`` are read by
    the matching alone, however often the steps after it read its result."""
    ensure_checkpoint_dir(queries.sparkSession)
    best = best_match(queries, registry, threshold, qid, qname, rid, rname)
    best = best.withColumn("qs", clean_sorted("query_name")).checkpoint()
    new = best.filter(F.col("matched_id").isNull() & (F.length("qs") > 0))
    spelling = new.groupBy("qs").agg(F.min("query_name").alias(rname))
    lead = lead_names(spelling.select("qs"), threshold).checkpoint()
    leaders = lead.where("qs = leader").select("leader")
    new_rows = dense_ids(leaders, ["leader"], _last_id(registry, rid, leaders, claim), rid)
    ids = lead.join(new_rows, "leader").select("qs", rid)
    res = best.join(ids, "qs", "left").select(
        "query_id", "query_name", F.coalesce("matched_id", rid).alias("resolved_id"),
        F.col("matched_id").isNull().alias("is_new"))
    return res, new_rows.join(spelling, F.col("leader") == F.col("qs")).select(rid, rname)


def new_dictionary_rows(batch: DataFrame, dictionary: DataFrame, keys: list[str],
                        id_col: str, claim: Callable[[int, int], int] | None = None) -> DataFrame:
    """Distinct natural keys of the batch missing from the dictionary, with
    new ids after the largest existing id, or after the range that ``claim``
    gives (in key order)."""
    ensure_checkpoint_dir(batch.sparkSession)
    fresh = batch.select(*keys).dropna().distinct().join(dictionary.select(*keys), keys, "left_anti").checkpoint()
    return dense_ids(fresh, keys, _last_id(dictionary, id_col, fresh, claim), id_col)
