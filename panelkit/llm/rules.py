"""Operator 3: quality rules and robust multivariate outliers.

One Arrow pass turns every whole text into a few counts. Their transforms form
a vector; for every language and source its minimum-covariance-determinant
estimate (the mean and covariance of the tightest half of the rows) is found by
concentration steps, each of them one aggregation over all rows: rows of a group
are summed into bins of their distance to the last estimate, and the nearest
bins that make up a half give the next. Several starts take the first steps, the
tightest goes on. Vectors too far from their group's estimate by Mahalanobis
distance are rejected."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import add_columns, documents, nothing_kept, packed, unpacked, written

#: Base rules: fewest words, and the largest share (percent) of repeated words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

#: Share of a group's rows that its estimate is made from (junk up to the rest of
#: them can't hide itself); concentration steps; rows below which a group takes
#: its language's estimate (or that of all).
SHARE, STEPS, LEAST_ROWS = 0.5, 12, 60

#: Steps that every start takes, and by how much another start's log_det must be
#: less than that of the first (medians and quartiles) to replace it: less apart
#: are two halves of the same clean rows, junk in a half costs a multiple.
TRIED, CLEARLY = 3, 0.25

#: Squared distance beyond which a vector is rejected. Statistics of texts have
#: heavy tails, so this lies far beyond the chi-square quantiles.
CUTOFF = 75.0

#: Least standard deviation of each transformed statistic, so that one that
#: hardly varies among clean texts doesn't reject for a single occurrence.
FLOORS = {"x_length": 0.03, "x_symbols": 0.15, "x_lines": 0.10, "x_repeats": 0.08, "x_same": 0.03}
X = list(FLOORS)
PAIRS = [(i, j) for i in range(len(X)) for j in range(i, len(X))]

# The characters counted as symbols, and those between words.
SYMBOLS, WHITE = "#*$%&|<>", " \t\n\x0b\x0c\r"

COUNTS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_lines long, n_same long")

_TIMES = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1 for j in range(WINDOW)], np.uint64)


def repeated_words(h: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more (all
    occurrences count). ``h``: a 64-bit hash of each word."""
    n = len(h) - WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        s = sum(h[j:j + n] * _TIMES[j] for j in range(WINDOW))
    order = np.argsort(s, kind="stable")
    same = s[order[1:]] == s[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    cover[:n] += twice
    cover[WINDOW:] -= twice
    return int((np.cumsum(cover)[:len(h)] > 0).sum())


def counts(texts: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {k.split()[0]: [] for k in COUNTS.split(", ")}
    for t in texts:
        words = t.encode().split()  # ASCII white space only
        n = len(words)
        lines = [x for x in t.split("\n") if x.strip(WHITE)]
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        row = (n, len(t) - sum(map(t.count, WHITE)), sum(map(t.count, SYMBOLS)),
               len(lines) - len(set(lines)), repeated_words(h), len(lines),
               int((h[1:] == h[:-1]).sum()))
        for k, v in zip(out, row):
            out[k].append(v)
    return out


def with_counts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts of each whole text (null: none), base_failed and
    the transformed statistics. Short texts are drawn towards usual values."""
    def make():
        nothing_kept()
        return counts

    df = add_columns(docs, "text", COUNTS, make, keep)
    n = F.col("n_words").cast("double")
    return df.withColumns({
        "base_failed": (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        "x_length": F.log((F.col("word_chars") + 250) / (n + 50)),
        "x_symbols": F.log1p(10 * F.col("n_symbols") / (n + 10)),
        "x_lines": F.col("n_dup_lines") / (F.col("n_lines") + 5.0),
        "x_repeats": F.col("n_repeat_words") / (n + 20),
        "x_same": F.col("n_same") / (n + 20)})


def _chi_square(x: float, dof: int) -> float:
    """Distribution function, by the series of the incomplete gamma function."""
    a, x = dof / 2, x / 2
    term = total = 1 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def consistency(share: float, dof: int) -> float:
    """What the covariance of the nearest ``share`` of normal rows falls short by."""
    low, high = 1e-6, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(mid, dof) < share else (low, mid)
    return share / _chi_square(low, dof + 2)


GROUP = ["level", "g_lang", "g_source"]
_MODEL = ("level int, g_lang string, g_source string, start int, n_rows long, log_det double, "
          + ", ".join(f"m_{x} double" for x in X) + ", "
          + ", ".join(f"w_{i}_{j} double" for i, j in PAIRS))


def _solve(factor: float):
    """Moments of each group -> mean and inverse covariance."""
    floors = np.array([FLOORS[x] for x in X])

    def run(frames):
        for f in frames:
            n = f["n"].to_numpy(float)
            mean = f[[f"s_{x}" for x in X]].to_numpy(float) / n[:, None]
            cov = np.zeros((len(f), len(X), len(X)))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = f[f"p_{i}_{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
            cov = np.maximum(factor, 1.0) * cov + np.diag(floors ** 2)
            inverse = np.linalg.inv(cov)
            out = f[[*GROUP, "start", "n_rows"]].copy()
            out["log_det"] = np.linalg.slogdet(cov)[1]
            for i, x in enumerate(X):
                out[f"m_{x}"] = mean[:, i]
            for i, j in PAIRS:
                out[f"w_{i}_{j}"] = inverse[:, i, j]
            yield out
    return run


def distance() -> Column:
    """Squared Mahalanobis distance, as an expression of statistics and model."""
    d = [F.col(x) - F.col(f"m_{x}") for x in X]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1.0 if i == j else 2.0) * F.col(f"w_{i}_{j}") * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _of_group(rows: DataFrame, model: DataFrame, how: str = "inner") -> DataFrame:
    m = model.withColumnsRenamed({"level": "_l", "g_lang": "_g", "g_source": "_s"})
    return rows.join(m, F.expr("level = _l and g_lang <=> _g and g_source <=> _s"), how).drop(
        "_l", "_g", "_s")


def _starts(quartiles: DataFrame) -> DataFrame:
    """The first estimates of each group: medians with spreads from quartiles,
    then medians, lower and upper quartiles with the least spreads (which junk
    can't widen)."""
    least = {x: F.lit(FLOORS[x]) for x in X}
    spread = {x: F.greatest((F.col(f"q_{x}")[2] - F.col(f"q_{x}")[0]) / 1.349, least[x]) for x in X}
    starts = [F.struct(
        F.lit(k).alias("start"), F.lit(0.0).alias("log_det"),
        *[F.col(f"q_{x}")[at].alias(f"m_{x}") for x in X],
        *[(1 / (s[X[i]] * s[X[i]]) if i == j else F.lit(0.0)).alias(f"w_{i}_{j}") for i, j in PAIRS])
        for k, (at, s) in enumerate([(1, spread), (1, least), (0, least), (2, least)])]
    return quartiles.select(*GROUP, "n_rows", F.explode(F.array(*starts)).alias("e")).select(
        *GROUP, "n_rows", "e.*")


def _tightest(model: DataFrame) -> DataFrame:
    """One start of each group: that of the least log_det, the first one where
    no other is clearly less."""
    rest = [c for c in model.columns if c not in GROUP]
    rank = F.struct(F.col("log_det") - F.when(F.col("start") == 0, CLEARLY).otherwise(0.0), F.col("start"))
    return model.groupBy(*GROUP).agg(F.min_by(F.struct(*rest), rank).alias("e")).select(*GROUP, "e.*")


def fit(stats: DataFrame) -> DataFrame:
    """Estimates of every language and source (level 2), language (1) and of all
    (0), from every row that passes the base rules.

    A null language or source is a group like any other. Without rows there
    is no estimate."""
    none = F.lit(None).cast("string")
    rows = stats.where(~F.col("base_failed")).select(
        "lang", "source", *X, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level"))
    rows = rows.select("level", F.when(F.col("level") > 0, F.col("lang")).otherwise(none).alias("g_lang"),
                       F.when(F.col("level") > 1, F.col("source")).otherwise(none).alias("g_source"), *X)
    quartiles = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q_{x}") for x in X])
    model = written(_starts(quartiles), "estimates")
    factor = consistency(SHARE, len(X))
    each = [*GROUP, "start", "n_rows"]
    near = Window.partitionBy(*GROUP, "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for step in range(STEPS):
        if step == TRIED:
            model = written(_tightest(model), "estimates")
        at = _of_group(rows, model).withColumn(
            "bin", F.floor(16 * F.log2(1 + distance())).cast("int"))
        cells = at.groupBy(*each, "bin").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s_{x}") for x in X],
            *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p_{i}_{j}") for i, j in PAIRS])
        # The nearest bins up to SHARE of the rows; the last counts in part.
        left = F.ceil(F.col("n_rows") * SHARE) - F.coalesce(F.sum("n").over(near), F.lit(0))
        cells = cells.withColumn("part", F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / F.col("n"))))
        sums = ["n", *[f"s_{x}" for x in X], *[f"p_{i}_{j}" for i, j in PAIRS]]
        moments = cells.where("part > 0").groupBy(*each).agg(
            *[F.sum(F.col(c) * F.col("part")).alias(c) for c in sums])
        model = written(moments.mapInPandas(_solve(factor), _MODEL), "estimates")
    return model.drop("start")


def judged(rows: DataFrame, model: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``rows`` (as ``with_counts`` gives them) with distance and kept.

    The estimate is that of the row's language and source, or where those have
    fewer than LEAST_ROWS rows, of its language, or of all. Rows that fail the
    base rules are not kept; with no estimate at all there is no verdict
    against a row."""
    values = [c for c in model.columns if c not in (*GROUP, "n_rows", "log_det")]
    enough = model.where(F.col("n_rows") >= LEAST_ROWS)
    best = enough.where("level = 2").select(
        F.col("g_lang").alias("l2"), F.col("g_source").alias("s2"), F.struct(*values).alias("e2"))
    mid = enough.where("level = 1").select(F.col("g_lang").alias("l1"), F.struct(*values).alias("e1"))
    top = model.where("level = 0").select(F.struct(*values).alias("e0")).first()  # one row
    out = rows.join(best, F.expr("lang <=> l2 and source <=> s2"), "left").join(
        mid, F.expr("lang <=> l1"), "left")
    zero = (F.struct(*[F.lit(top["e0"][v]).alias(v) for v in values]) if top
            else F.lit(None).cast("struct<" + ",".join(f"{v}:double" for v in values) + ">"))
    out = out.withColumn("__e", F.coalesce("e2", "e1", zero))
    out = out.withColumns({v: F.col("__e")[v] for v in values}).withColumn("distance", distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.withColumn("kept", kept).drop("l1", "l2", "s2", "e1", "e2", "__e", *values)


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): the counts, base_failed,
    distance and kept. Null and empty texts have no words and fail; repeated
    rows stay, each with its verdict; other columns are not read."""
    stats = written(with_counts(docs, ["doc_id", "lang", "source"]), "counts")
    return judged(stats, fit(stats), cutoff)


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. Texts don't shuffle:
    they are counted once for the estimates and once more for the verdict."""
    model = fit(written(with_counts(docs, ["lang", "source"]), "counts"))
    apart = ["text", "lang", "source"]
    rows = judged(with_counts(packed(docs, apart), ["__row", *apart]), model, cutoff).where("kept")
    return unpacked(rows, docs.columns, apart)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, judged."""
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance")
