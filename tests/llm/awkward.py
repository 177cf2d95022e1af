"""A small table with everything that tables shouldn't have."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "river", "stone", "light"])
                    + str(rng.randrange(40)) for _ in range(words))


def rows():
    long = prose(99, 30_000)
    out = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n ", "en", None, 4),
           (4, prose(4, 60), "en", "a", 1), (5, prose(4, 60), "en", "a", 1), (4, prose(4, 60), "en", "a", 1),
           (6, long, "de", "b", 2), (7, "x" * 50_000, "en", "b", 3), (None, prose(8, 40), "en", "a", 5),
           (9, "<|endoftext|> a<|endoftext|>b", "en", "a", 6), (10, "one two", None, None, None),
           (11, "one two", "fr", "c", 7), (12, "Ñandú 漢字 🎉 don't 'll \x1c \x85x", "es", "c", 8)]
    return out + [(20 + i, prose(50 + i, 80), "en", "a", i) for i in range(12)]


#: Names that operators use for what they add.
EXTRA = ["score", "predicted", "kept", "distance", "n_tokens", "ids", "shard", "slot", "rank", "n",
         "key", "size", "epoch", "block", "level", "word", "bits", "cid", "comp", "number", "l1", "e0"]


def table(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in EXTRA])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
