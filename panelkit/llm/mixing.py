"""Operator 5: mixing sources by temperature, DataFrame operations only.

Source token shares p become weights p^t / sum p^t. The exponent t is bisected
until the weights meet a target entropy or a limit on how often a source may be
repeated; every pass over the (one row a source) statistics tries the midpoints
of several bisection steps at once. The weights and a token budget are then
realised as block permutations: each source is read in epochs, each epoch its
own permutation, cut where its budget ends; the mix is a sequence of blocks
with the same budget that hold every source in its weight, shuffled within."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, numbered, written

#: Bisection steps a pass does at once, and passes.
STEPS, PASSES = 5, 6

#: Exponents are sought between these: 0 makes all sources equal, 1 keeps their
#: own shares, more sharpens them.
LEAST, MOST = 0.0, 4.0

#: Rows of a source that are put in order together, on average at most.
TOGETHER = 10_000

#: Tokens of a block of the mix.
BLOCK_TOKENS = 1 << 20


@dataclass(frozen=True)
class Mix:
    """What the bisection found."""
    exponent: float
    entropy: float
    budget: float


def _trials(stats: DataFrame, total: float, exponents: list[float]) -> list[dict]:
    """For each exponent: its entropy, the budget at which no source is read
    less than once, and the most and fewest repeats for a budget of 1."""
    p = F.col("tokens") / F.lit(float(total))
    aggs = []
    for i, t in enumerate(exponents):
        aggs += [F.sum(F.pow(p, F.lit(t))).alias(f"z{i}"),
                 F.sum(F.pow(p, F.lit(t)) * F.log(p)).alias(f"l{i}"),
                 F.max(F.pow(p, F.lit(t - 1))).alias(f"hi{i}"),
                 F.min(F.pow(p, F.lit(t - 1))).alias(f"lo{i}")]
    r = stats.agg(*aggs).first()
    return [dict(t=t, entropy=math.log(r[f"z{i}"]) - t * r[f"l{i}"] / r[f"z{i}"],
                 most=r[f"hi{i}"] / r[f"z{i}"] / total, least=r[f"lo{i}"] / r[f"z{i}"] / total)
            for i, t in enumerate(exponents)]


def _bisect(stats, total, low: float, high: float, holds) -> dict:
    """The smallest exponent for which ``holds`` (false below, true above)."""
    ends = _trials(stats, total, [low, high])
    if holds(ends[0]):
        return ends[0]
    if not holds(ends[1]):
        return ends[1]
    best = ends[1]
    for _ in range(PASSES):
        n = 1 << STEPS
        grid = _trials(stats, total, [low + (high - low) * k / n for k in range(1, n)])
        below = [x for x in grid if not holds(x)]
        above = [x for x in grid if holds(x)]
        low = below[-1]["t"] if below else low
        best = above[0] if above else best
        high = best["t"]
    return best


def source_stats(docs: DataFrame) -> DataFrame:
    """tokens and rows of each source (null is a source)."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"),
                                      F.count(F.lit(1)).alias("rows"))


def find_mix(stats: DataFrame, target_entropy: float | None = None,
             max_repeats: float | None = None, budget: float | None = None) -> Mix | None:
    """The exponent that meets the target entropy (in nats, reached from above)
    or, with a limit on repeats, the flattest mix that keeps to it (both: the
    larger exponent). ``budget`` None: the least that reads every source whole
    once. None if there are no rows."""
    head = stats.agg(F.sum("tokens").alias("t")).first()
    if not head["t"]:
        return None
    total = float(head["t"])

    def size(x: dict) -> float:
        return budget if budget is not None else 1.0 / x["least"]

    found = []
    if target_entropy is not None:
        found.append(_bisect(stats, total, LEAST, MOST, lambda x: x["entropy"] <= target_entropy))
    if max_repeats is not None:
        # The tolerance is that of the bisection's last step.
        got = _bisect(stats, total, LEAST, 1.0,
                      lambda x: x["most"] * size(x) <= max_repeats * (1 + 1e-9))
        if got["most"] * size(got) > max_repeats * (1 + 1e-6):
            raise ValueError("the budget repeats sources more often than the limit allows")
        found.append(got)
    best = max(found, key=lambda x: x["t"]) if found else _trials(stats, total, [1.0])[0]
    return Mix(best["t"], best["entropy"], size(best))


def _draw(*cols: Column, salt: str) -> Column:
    """A uniform 60-bit number from the columns, the same everywhere: the head
    of an MD5 digest."""
    text = F.concat_ws("|", F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mixed(docs: DataFrame, mix: Mix | None, stats: DataFrame, salt: str = "mix",
          block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of the mix: doc_id, source, tie, n_tokens, epoch, block, slot.

    ``docs`` has doc_id, source, tie, n_tokens (positive). A row is taken in an
    epoch if its source's budget is not used up where the row starts. Rows of
    equal doc_id keep together within an epoch; slots number the whole mix."""
    if mix is None:
        return docs.select("doc_id", "source", "tie", "n_tokens", F.lit(0).alias("epoch"),
                           F.lit(0).cast("long").alias("block"),
                           F.lit(0).cast("long").alias("slot")).limit(0)
    norm = stats.agg(F.sum(F.pow("tokens", F.lit(mix.exponent)))).first()[0]
    count = stats.agg(F.sum("rows")).first()[0]
    buckets, width = max(1, -(-count // TOGETHER)), 1 << 60
    share = stats.select(F.col("source").alias("of"), F.col("tokens").alias("whole"), (
        F.pow("tokens", F.lit(mix.exponent)) * F.lit(mix.budget / norm)).alias("target"))
    # A target that is a whole number of epochs up to rounding is one, in tokens,
    # so that the last rows of its permutations are read whatever their size.
    turns = F.round(F.col("target") / F.col("whole"))
    share = share.withColumn("target", F.when(
        (turns >= 1) & (F.abs(F.col("target") / F.col("whole") - turns) <= 1e-9),
        turns * F.col("whole")).otherwise(F.col("target")))
    rows = docs.join(share, F.expr("source <=> of")).drop("of")
    epochs = F.greatest(F.lit(1), F.ceil(F.col("target") / F.col("whole") - F.lit(1e-6))).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    rows = rows.withColumn("draw", _draw(F.col("source"), F.col("epoch"), F.col("doc_id"), salt=salt))
    rows = rows.withColumn("bucket", F.floor(F.col("draw") / F.lit(-(-width // buckets))).cast("long"))
    # Where each row starts in its epoch: sums of the buckets before (few rows)
    # plus a running sum within its own bucket.
    cell = ["source", "epoch", "bucket"]
    sums = rows.groupBy(*cell).agg(F.sum("n_tokens").alias("here"))
    before = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("bucket").alias("b"),
                       F.coalesce(F.sum("here").over(before), F.lit(0)).alias("earlier"))
    rows = rows.join(sums, F.expr("source <=> s and epoch = e and bucket = b")).drop("s", "e", "b")
    inside = Window.partitionBy(*cell).orderBy("draw", "doc_id", "tie", "n_tokens").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("whole") * F.col("epoch") + F.col("earlier")
                           + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    rows = rows.where(F.col("start") < F.col("target"))
    blocks = max(1, math.ceil(mix.budget / block_tokens))
    rows = rows.withColumn("block", F.least(F.lit(blocks - 1), F.floor(
        F.col("start") / F.col("target") * F.lit(blocks))).cast("long"))
    rows = rows.withColumn("shuffle", _draw(F.col("block"), F.col("epoch"), F.col("doc_id"),
                                            salt=salt + "|block"))
    rows = rows.select("doc_id", "source", "tie", "n_tokens", "epoch", "block", "shuffle")
    out = numbered(rows, [F.col("block"), F.col("shuffle"), F.col("doc_id"), F.col("tie"),
                          F.col("source"), F.col("epoch"), F.col("n_tokens")], "mix", number="slot")
    return out.drop("shuffle")


def with_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, source, tie (the text's hash) and n_tokens: words of the whole text plus an end token
    (null and empty texts: the end token)."""
    text = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "[ \\t\\n\\x0B\\f\\r]+")))
    return docs.select("doc_id", "source", F.xxhash64("text").alias("tie"), (words + 1).cast("long").alias("n_tokens"))


def temperature_mix(docs: DataFrame, target_entropy: float | None = None,
                    max_repeats: float | None = None, budget: float | None = None,
                    salt: str = "mix", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix of ``docs`` (doc_id, source, text): see ``find_mix``, ``mixed``.

    A null source is a source, null and empty texts count one token, repeated
    rows are mixed each by itself, an empty table gives an empty mix. Other
    columns are not read."""
    sized = written(with_tokens(docs), "sized")
    stats = written(source_stats(sized), "stats")
    mix = find_mix(stats, target_entropy, max_repeats, budget)
    return mixed(sized, mix, stats, salt, block_tokens)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents themselves, in the order of the mix and repeated as it says,
    with the columns of ``docs``. Rows of equal doc_id and text are repeats of
    one document: the mix holds each, with the columns of one of them."""
    # Keys without nulls, so that the texts shuffle once for both steps.
    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "tie"]
    plan = temperature_mix(docs, **settings).select(*key, "slot")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"),
                       F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")).select(*key, "row")
    both = rows.dropDuplicates(["id", "no_id", "tie"]).join(plan, ["id", "no_id", "tie"])
    return both.select("slot", "row").orderBy("slot").select("row.*")


#: The mix that the query makes: no source more than twice as often as another.
MAX_REPEATS = 2.0


def op5_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    """``documents`` mixed as flat as two epochs of any source allow, with every
    document in it at least once."""
    return temperature_mix(documents(spark, sf_dir), max_repeats=MAX_REPEATS).drop("tie")
