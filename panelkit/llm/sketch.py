"""Operator 7: bottom-k fingerprints of documents, DataFrame operations only.

A fingerprint holds the k smallest distinct 48-bit hashes of a text's word
shingles (five words; a shorter text is one shingle, a text without words has
none). Sketches of parts merge into the sketch of the whole; two sketches
estimate resemblance and containment, one the number of distinct shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, numbered

#: Hashes kept, words a shingle has, and hexadecimal digits of a hash.
K, WORDS, DIGITS = 64, 5, 12

_WHITE = " \t\n\x0b\x0c\r"


def _hash(words: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(words), 64 - 4 * DIGITS)


def sketch(text: Column, k: int = K, width: int = WORDS) -> Column:
    """The k smallest distinct shingle hashes, ascending (null text: empty)."""
    words = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE)), "[ \\t\\n\\x0B\\f\\r]+")
    # A text without words splits into one empty string.
    words = F.filter(words, lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        return (F.when(n == 0, F.array().cast("array<bigint>"))
                .when(n <= width, F.array(_hash(w)))
                .otherwise(F.transform(F.sequence(F.lit(1), n - (width - 1)),
                                       lambda i: _hash(F.slice(w, i, width)))))
    # transform over a one-element array names the words, so they are split once.
    all_ = F.element_at(F.transform(F.array(words), hashes), 1)
    return F.slice(F.sort_array(F.array_distinct(all_)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; equal sketches (empty ones too) give 1."""
    both = merged(a, b, k)
    return (F.when(a == b, F.lit(1.0))
            .otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below k)."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(
        (k - 1) * float(1 << (4 * DIGITS)) / F.element_at(a, k).cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too (null: a has none)."""
    whole = distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(
        F.lit(1.0), resemblance(a, b, k) * whole / distinct_shingles(a, k)))


def to_text(a: Column) -> Column:
    """Fingerprint as text: twelve hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def from_text(s: Column) -> Column:
    """Sketch of a fingerprint's text."""
    n = (F.length(s) / DIGITS).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(
        F.substr(s, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K,
                 width: int = WORDS) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint and distinct shingles."""
    s = df.select(F.col(f"`{doc_id}`").alias("doc_id"),
                  sketch(F.col(f"`{text}`"), k, width).alias("sketch"))
    return s.select("doc_id", to_text(F.col("sketch")).alias("fingerprint"),
                    distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"))


def edited_fingerprints(df: DataFrame, k: int = K, width: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third of its
    code points give way to the first as many of the next document's in
    descending doc_id order (after the last comes the first).

    Null texts are empty, a null doc_id comes last. Rows that repeat a doc_id
    stay, each with its own text; as a next document the one with the greatest
    head stands for them. Reads doc_id and text only."""
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = docs.withColumn("sketch", sketch(F.col("text"), k, width))
    # The order of ids, numbered without one task for all; each document then
    # learns who asks for its head and how much of it.
    ids = docs.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))
    order = numbered(ids, [F.col("doc_id").desc_nulls_last()], "order")
    total = order.count()
    after = order.select(F.col("doc_id").alias("next_id"),
                         F.expr(f"case when number = 0 then {max(total, 1) - 1}L "
                                "else number - 1 end").alias("number"))
    asks = order.join(after, "number").select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("asked_by"),
        F.expr("n div 3").cast("int").alias("asked"))
    lend = base.alias("b").join(asks.alias("q"), F.expr("b.doc_id <=> q.doc_id")).select(
        "asked_by", F.struct(F.expr("left(b.text, q.asked)").alias("head"),
                             F.col("b.sketch").alias("sketch")).alias("lent"))
    lend = lend.groupBy("asked_by").agg(F.max("lent").alias("lent"))
    joined = base.alias("b").join(lend.alias("l"), F.expr("b.doc_id <=> l.asked_by"))
    own = joined.select(
        "doc_id", F.char_length("text").alias("n_chars"), "sketch",
        F.col("lent.sketch").alias("next_sketch"),
        F.expr("concat(left(text, char_length(text) - char_length(text) div 3), "
               "left(lent.head, cast(char_length(text) div 3 as int)))").alias("edited"))
    own = own.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "sketch", "next_sketch",
                     F.sha2(F.col("edited"), 256).alias("edited_sha256"),
                     sketch(F.col("edited"), k, width).alias("edited_sketch"))
    s, e, x = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return own.select("doc_id", "n_chars", "edited_sha256", to_text(s).alias("fingerprint"),
                      to_text(e).alias("edited_fingerprint"),
                      resemblance(s, e, k).alias("near_edited"),
                      resemblance(s, x, k).alias("near_next"),
                      distinct_shingles(s, k).alias("distinct_shingles"))


def op7_bottom_k_sketch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text."""
    return edited_fingerprints(documents(spark, sf_dir))
