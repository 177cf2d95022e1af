"""Operator 6: n-gram Jaccard join and its components.

Every text is a set of word n-grams (64-bit hashes). Texts with equal sets form
one class, whose size no later step sees. Sets are ordered rare-first, by a
fixed-size estimate of n-gram frequencies over all texts (the least of several
hashed counts, on a logarithmic scale without an end), ties by hash. Two sets with
Jaccard likeness t or more must share an n-gram within their first
n - ceil(t n) + 1 (the prefix), so classes meet on prefix n-grams only.

Candidate pairs pass length, positional and suffix filters and are then verified
once, on whole sets. The suffix filter bounds the symmetric difference of two
sets from below: n-grams are dealt to 512 (then 2048) parts, a set keeps the parity
of each part's count, and parts of unlike parity hold a difference each.

Components need no pair within what is already linked. Round one verifies, for
each prefix n-gram, its classes against the least of them, round two those in
another component against one picked at random for each n-gram, and round three
all remaining pairs of classes that share a prefix n-gram but no component. No
link is lost and a family of copies is never expanded into all its pairs."""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, nothing_kept, slices, sparing, written

#: Counts an n-gram has (its estimate is the least), buckets of each (as a power
#: of two, one byte) and words of a bitmap (16 bytes a row): all are broadcast, 8
#: and 4 MB whatever the input.
ROWS, RARITY_BITS, BITMAP_WORDS = 2, 22, 18

#: Buckets that travel together, compressed.
CHUNK = 1 << 14

#: Steps of the estimate for a doubling (a byte then holds 2^42).
STEPS = 6

#: Classes whose prefixes a task has sent, as far as it remembers.
REMEMBERED = 100_000

#: Parts whose parities the suffix filter compares: first few, then, for the
#: pairs that pass, many (long sets differ in too many n-grams for few parts).
PARTS, FINE = 512, 2048
ODD = [f"o{i}" for i in range(PARTS // 64)]

#: Rounds against picked classes, before all remaining pairs.
PICKS = 2

_MIX = 0x9E3779B97F4A7C15


def _weights(width: int) -> np.ndarray:
    return np.array([(_MIX * (2 * j + 1) ** 3) & (2**64 - 1) | 1 for j in range(width)], np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_set(text: str, width: int) -> np.ndarray:
    """Distinct n-gram hashes of a text, ascending. A-Z are lower-cased, words
    are runs without ASCII white space; with fewer words than ``width`` the
    whole sequence is one n-gram, without words there is none."""
    from xxhash import xxh3_64_intdigest
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, width)
    w = _weights(width)
    with np.errstate(over="ignore"):
        s = reduce(np.add, (h[j:n - k + 1 + j] * w[j] for j in range(k)))
        return np.unique(_finish(s + np.uint64(k)))


def _texts(batch: pa.RecordBatch, column: int):
    """(first row, texts) of a batch, in pieces of bounded size."""
    col = batch.column(column)
    step = max(1, (1 << 20) * max(1, len(col)) // max(1, col.nbytes))
    for at in range(0, batch.num_rows, step):
        part = [x or "" for x in col.slice(at, step).to_pylist()]
        for lo, hi in slices([len(x) for x in part]):
            yield at + lo, part[lo:hi]


def _buckets(sets: np.ndarray, row: int) -> np.ndarray:
    """The bucket of each n-gram in one row of counts: bits of its hash that the
    other rows don't use."""
    return (sets >> np.uint64(64 - RARITY_BITS * (row + 1)) & np.uint64((1 << RARITY_BITS) - 1)).astype(np.int64)


def estimate(counts: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """How frequent n-grams are: the least of their logarithmic counts."""
    return reduce(np.minimum, (counts[r][_buckets(sets, r)] for r in range(ROWS)))


def logarithmic(n: np.ndarray) -> np.ndarray:
    return np.rint(STEPS * np.log2(1.0 + n)).astype(np.uint8)


def pieces_of(sets: list[np.ndarray]):
    """The members of all sets, in pieces of fewer than 2^16."""
    flat = np.concatenate(sets)
    for at in range(0, len(flat), 65535):
        yield flat[at:at + 65535]


def rarity(docs: DataFrame, width: int) -> np.ndarray:
    """Rows of counts of n-grams over all texts, on a logarithmic scale. Tasks
    count (in two bytes, sending what they have before one overflows), then one
    task a few chunks adds up."""
    size = 1 << RARITY_BITS

    def rows(total: np.ndarray, chunks) -> pa.RecordBatch:
        packed = []
        for c in chunks:
            n = total[c]
            kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if n.max() <= np.iinfo(k).max)
            packed.append(kind[2].encode() + zlib.compress(n.astype(kind).tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array(packed, pa.binary())],
                                          names=["chunk", "counts"])

    def numbers(counts: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(counts[1:]), f"<u{counts[:1].decode()}")

    def count(batches):
        nothing_kept()
        total = np.zeros((ROWS, size), np.uint16)
        for b in batches:
            for _, texts in _texts(b, 0):
                for some in pieces_of([ngram_set(t, width) for t in texts]):
                    found = [np.unique(_buckets(some, r), return_counts=True) for r in range(ROWS)]
                    if any((total[r][bucket] + n > 65535).any() for r, (bucket, n) in enumerate(found)):
                        yield rows(total.reshape(-1, CHUNK), range(ROWS * size // CHUNK))
                        total[:] = 0
                    for r, (bucket, n) in enumerate(found):
                        total[r][bucket] += n.astype(np.uint16)
        yield rows(total.reshape(-1, CHUNK), range(ROWS * size // CHUNK))

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = numbers(counts).astype(np.uint64)
                total[chunk] = total[chunk] + n if chunk in total else n
        for chunk, n in total.items():
            yield rows({chunk: logarithmic(n)}, [chunk])

    schema = "chunk int, counts binary"
    got = docs.select("text").mapInArrow(sparing(count), schema).repartition("chunk").mapInArrow(sparing(add), schema)
    out = np.zeros((ROWS * size // CHUNK, CHUNK), np.uint8)
    for r in got.collect():  # one row a chunk
        out[r["chunk"]] = numbers(r["counts"])
    return out.reshape(ROWS, size)


def prefixes(docs: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """Per document: doc_id, n (set size), cid and twin (two halves of the
    class's 128-bit digest; null for an empty set), o0 to o7 and fine (the
    suffix filter's parities), keys (48-bit prefix n-grams, rarest first; only the first
    document of a class in a task has them)."""
    from_histogram = docs.sparkSession.sparkContext.broadcast(rarity(docs, width))

    def run(batches):
        nothing_kept()
        freq, seen = from_histogram.value, set()
        for b in batches:
            for at, texts in _texts(b, 1):
                out = {k: [] for k in ("n", "cid", "twin", *ODD, "fine", "keys")}
                for t in texts:
                    s = ngram_set(t, width)
                    n = len(s)
                    row = [n, None, None, *[None] * len(ODD), None, None]
                    if n:
                        d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                        count = np.bincount((s & np.uint64(FINE - 1)).astype(np.int64), minlength=FINE)
                        fine = np.packbits((count & 1).astype(np.uint8), bitorder="little").view("<i8")
                        # equal places of every PARTS parities make one coarse part
                        odd = np.bitwise_xor.reduce(fine.reshape(-1, len(ODD)))
                        row[1:-1] = [int(d[0]), int(d[1]), *odd.tolist(), fine]
                        if (row[1], row[2]) not in seen:
                            if len(seen) >= REMEMBERED:
                                seen.clear()  # a class sent twice costs rows, no more
                            seen.add((row[1], row[2]))
                            p = n + (-part * n // whole) + 1
                            # ascending hashes, so a stable sort breaks ties by hash
                            rare = np.argsort(estimate(freq, s), kind="stable")[:p]
                            row[-1] = (s[rare] >> np.uint64(16)).astype(np.int64)
                    for k, v in zip(out, row):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(out["n"], pa.int64()),
                     *[pa.array(out[k], pa.int64()) for k in ("cid", "twin", *ODD)],
                     *[pa.array(out[k], pa.list_(pa.int64())) for k in ("fine", "keys")]],
                    names=["doc_id", *out])
    return docs.select("doc_id", "text").mapInArrow(
        sparing(run), "doc_id long, n long, cid long, twin long, " + ", ".join(f"{o} long" for o in ODD)
        + ", fine array<long>, keys array<long>")


def bitmap(df: DataFrame, of: Column) -> DataFrame:
    """Rows (word, bits) of a bitmap with a bit set for each value's hash: a
    filter of fixed size that lets all the values through and few others."""
    h = F.xxhash64(of)
    return (df.select(F.shiftrightunsigned(h, 64 - BITMAP_WORDS).alias("word"),
                      F.expr("1L").alias("one"), h.bitwiseAND(F.lit(63)).cast("int").alias("place"))
            .select("word", F.expr("shiftleft(one, place)").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))


def through(df: DataFrame, of: Column, bits: DataFrame) -> DataFrame:
    """The rows of ``df`` that the (broadcast) bitmap lets through."""
    h = F.xxhash64(of)
    rows = df.withColumn("__word", F.shiftrightunsigned(h, 64 - BITMAP_WORDS)).withColumn(
        "__place", h.bitwiseAND(F.lit(63)).cast("int"))
    out = rows.join(F.broadcast(bits), F.expr(
        "__word = word and shiftrightunsigned(bits, __place) % 2 != 0"), "left_semi")
    return out.drop("__word", "__place")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the links: rows (id, comp), comp the least id.

    Every round takes the least label of the neighbours and then the label of
    that label, so long chains shorten by half; labels are written each round."""
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = written(edges.union(edges.select("y", "x")).distinct(), "edges")
    labels = written(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("comp"))
                     .withColumnRenamed("x", "id"), "labels")
    while True:
        # A row's own label goes into the same aggregation as its neighbours'.
        near = edges.join(labels.withColumnRenamed("id", "y"), "y").select(
            F.col("x").alias("id"), "comp", F.lit(None).cast(labels.schema["comp"].dataType).alias("old"))
        new = near.union(labels.select("id", "comp", F.col("comp").alias("old"))).groupBy("id").agg(
            F.max("old").alias("old"), F.min("comp").alias("comp"))
        up = labels.select(F.col("id").alias("up"), F.col("comp").alias("above"))
        new = written(new.join(up, F.col("comp") == F.col("up")).select(
            "id", "old", F.col("above").alias("comp")), "labels")
        labels = new.select("id", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


def _needed(part: int, whole: int, n1: str, n2: str) -> str:
    """SQL for the least overlap of sets with n1 and n2 members."""
    return f"(({part} * ({n1} + {n2}) + {part + whole - 1}) div {part + whole})"


def _fits(part: int, whole: int, a: str, b: str) -> str:
    """SQL for the length and suffix filters on columns n and o0.. of a and b."""
    apart = " + ".join(f"bit_count({a.format(o)} ^ {b.format(o)})" for o in ODD)
    n1, n2 = a.format("n"), b.format("n")
    return (f"{whole} * least({n1}, {n2}) >= {part} * greatest({n1}, {n2}) and "
            f"{apart} <= {n1} + {n2} - 2 * {_needed(part, whole, n1, n2)}")


class Join:
    """One join over a table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, width: int, part: int, whole: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.width, self.part, self.whole = width, part, whole
        self.members = written(prefixes(self.docs, width, part, whole), "prefixes")
        self.classes = written(self.members.where("cid is not null").groupBy("cid", "twin").agg(
            F.min("doc_id").alias("first_id"), *[F.max(c).alias(c) for c in ("n", *ODD)],
            F.first("fine").alias("fine")), "classes")
        self.entries = self.members.where("keys is not null").select(
            "cid", "n", F.posexplode("keys").alias("pos", "key"))

    def _near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (c1, c2) that pass the length and first suffix filter, with
        their sizes n_1 and n_2."""
        part, whole = self.part, self.whole
        info = self.classes.select("cid", "n", *ODD)
        for k in (1, 2):
            pairs = pairs.join(info.select(*[F.col(c).alias(f"{c}_{k}") for c in info.columns]),
                               F.expr(f"c{k} = cid_{k}")).drop(f"cid_{k}")
        return written(pairs.where(_fits(part, whole, "{}_1", "{}_2")).select("c1", "c2", "n_1", "n_2"), "near")

    def _similar(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs that ``_near`` gives, the links: second suffix filter,
        then whole sets, made from the text of one document a class."""
        part, whole = self.part, self.whole
        for k in (1, 2):
            pairs = pairs.join(self.classes.select(F.col("cid").alias("cid_k"), F.col("fine").alias(f"fine_{k}")),
                               F.expr(f"c{k} = cid_k")).drop("cid_k")
        pairs = pairs.where("aggregate(zip_with(fine_1, fine_2, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
                            f" <= n_1 + n_2 - 2 * {_needed(part, whole, 'n_1', 'n_2')}")
        pairs = written(pairs.select("c1", "c2").distinct(), "pairs")
        ids = pairs.select(F.col("c1").alias("cid")).union(pairs.select("c2")).distinct()
        first = written(self.classes.join(ids, "cid", "left_semi").select("first_id"), "first")
        width = self.width

        def sets(batches):
            nothing_kept()
            for b in batches:
                for _, texts in _texts(b, 0):
                    rows = [s for s in (ngram_set(t, width) for t in texts) if len(s)]
                    ids = [hashlib.blake2b(s.tobytes(), digest_size=8 * 2).digest() for s in rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int.from_bytes(d[:8], "little", signed=True) for d in ids],
                                  pa.int64()),
                         pa.array([s.view(np.int64) for s in rows], pa.list_(pa.int64()))],
                        names=["cid", "members"])
        docs = through(self.docs, F.col("doc_id"), bitmap(first, F.col("first_id")))
        docs = docs.join(first, F.expr("doc_id <=> first_id"), "left_semi")
        found = docs.select("text").mapInArrow(sparing(sets), "cid long, members array<long>")
        found = written(found, "sets")
        both = (pairs.join(found.select(F.col("cid").alias("c1"), F.col("members").alias("m1")), "c1")
                .join(found.select(F.col("cid").alias("c2"), F.col("members").alias("m2")), "c2"))
        both = both.select("c1", "c2", F.size("m1").alias("n1"), F.size("m2").alias("n2"),
                           F.size(F.array_intersect("m1", "m2")).alias("common"))
        return written(both.where(f"{whole} * common >= {part} * (n1 + n2 - common)")
                       .select("c1", "c2").distinct(), "links")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links between classes (a spanning part of each component), and the
        components (id, comp) of the classes that have any."""
        # The positional filter: sets that first meet at these places have no
        # more than the lesser rest in common. A late entry (whose rest is too
        # little for a set of its size or more) needs an early one of a smaller set.
        entries = self.entries.withColumns({"early": F.expr(f"n - pos >= {_needed(self.part, self.whole, 'n', 'n')}"),
                                            "both": F.expr("shiftleft(n, 32) | pos")})
        keys = entries.groupBy("key").agg(
            F.min("cid").alias("least"), F.max("cid").alias("most"), F.count(F.lit(1)).alias("k"),
            F.min_by("both", "cid").alias("a"), F.max_by("both", "cid").alias("b"),
            F.min(F.when(F.col("early"), F.col("n"))).alias("early_n"))
        keys = keys.select("key", "least", "most", "k", "early_n", *[F.expr(x).alias(c) for c, x in (
            ("n1", "shiftright(a, 32)"), ("pos1", "a & 4294967295"), ("n2", "shiftright(b, 32)"), ("pos2", "b & 4294967295"))])

        def near(n1: str, pos1: str, n2: str, pos2: str) -> str:
            return (f"{self.whole} * least({n1}, {n2}) >= {self.part} * greatest({n1}, {n2}) and "
                    f"least({n1} - {pos1}, {n2} - {pos2}) >= {_needed(self.part, self.whole, n1, n2)}")
        keys = written(keys.where("least <> most and early_n is not null and (k > 2 or "
                                  + near("n1", "pos1", "n2", "pos2") + ")"), "keys")
        # A key that two entries share needs nothing else; longer lists are read
        # again, each member to be held against the least.
        lists = keys.where("k > 2").select("key", "least", "n1", "pos1", "early_n")
        wide = through(entries, F.col("key"), bitmap(lists, F.col("key"))).join(lists, "key")
        wide = wide.where("early or early_n < n")
        wide = written(wide.join(self.classes.select("cid", *ODD).dropDuplicates(["cid"]), "cid").select(
            "key", "cid", "n", "pos", "least", "n1", "pos1", *ODD).distinct(), "wide")
        first = keys.where("k = 2").select(F.col("least").alias("c1"), F.col("most").alias("c2"))
        first = first.union(wide.where("cid <> least and " + near("n", "pos", "n1", "pos1")).select(
            "least", "cid")).distinct()
        links = self._similar(self._near(first))
        comps = components(links, "c1", "c2")
        for turn in range(PICKS + 1):
            # What shares a key but no component.
            rows = wide.join(comps, wide["cid"] == comps["id"], "left").select(
                *wide.columns, F.coalesce("comp", "cid").alias("comp"))
            split = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            open_ = written(rows.join(split.where("lo <> hi").select("key"), "key", "left_semi"), "open")
            if open_.isEmpty():
                break
            other = open_
            if turn < PICKS:
                draw = F.xxhash64("cid", "key", F.lit(turn))
                other = open_.groupBy("key").agg(F.min_by(F.struct(
                    *[c for c in open_.columns if c != "key"]), draw).alias("pick")).select("key", "pick.*")
            order = "a.cid <> b.cid" if turn < PICKS else "a.cid < b.cid and a.least <> a.cid"
            rest = open_.alias("b").join(other.alias("a"), F.expr(
                f"a.key = b.key and a.comp <> b.comp and {order} and "
                + _fits(self.part, self.whole, "a.{}", "b.{}")
                + " and least(a.n - a.pos, b.n - b.pos) >= " + _needed(self.part, self.whole, "a.n", "b.n")))
            rest = written(rest.select(F.least("a.cid", "b.cid").alias("c1"),
                                       F.greatest("a.cid", "b.cid").alias("c2"),
                                       F.least("a.n", "b.n").alias("n_1"),
                                       F.greatest("a.n", "b.n").alias("n_2")).distinct(), "rest")
            if not rest.isEmpty():
                links = links.union(self._similar(rest))
                comps = components(links, "c1", "c2")
        return links, comps

    def documents(self) -> DataFrame:
        """Per document: doc_id, n_shingles, component_id."""
        _, comps = self.links()
        rows = self.members.select("doc_id", "n", "cid", "twin")
        rows = rows.join(comps, rows["cid"] == comps["id"], "left").select(
            "doc_id", "n", F.coalesce("comp", "cid").alias("comp"),
            F.when(F.col("comp").isNull(), F.col("twin")).alias("twin"))
        least = rows.where("comp is not null").groupBy("comp", "twin").agg(
            F.min("doc_id").alias("least_id"))
        least = least.select(F.col("comp").alias("c"), F.col("twin").alias("t"), "least_id")
        return rows.join(least, F.expr("comp = c and twin <=> t"), "left").select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
            .alias("component_id"))


def similar_components(docs: DataFrame, width: int = 5, part: int = 8, whole: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are not read): doc_id,
    n_shingles, component_id, the least doc_id reachable by links of Jaccard
    likeness part/whole or more over ``width``-word shingles.

    Null, empty and white texts have no shingles and are linked with nothing.
    Rows that repeat a doc_id stay; a null doc_id is never the least of others."""
    return Join(docs, width, part, whole).documents()


def keep_one(docs: DataFrame, width: int = 5, part: int = 8, whole: int = 10) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its component, with
    their columns: one document of each group of near duplicates. Rows that
    share a doc_id stand or fall together, those of equal text once."""
    # Keys without nulls, so that the texts shuffle once for both steps.
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")]
    least = similar_components(docs, width, part, whole).where("doc_id <=> component_id").select(*key).distinct()
    rows = docs.select(*key, F.xxhash64("text").alias("tie"),
                       F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    rows = rows.join(least, ["id", "no_id"], "left_semi")
    return rows.dropDuplicates(["id", "no_id", "tie"]).select("row.*")


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of ``documents`` at likeness 0.9 over three-word shingles."""
    return similar_components(documents(spark, sf_dir), width=3, part=90, whole=100)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM pairs JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach AS (
  SELECT x AS doc_id, y AS other FROM links UNION SELECT y, x FROM links
  UNION
  SELECT r.doc_id, CASE WHEN l.x = r.other THEN l.y ELSE l.x END FROM reach r JOIN links l ON l.x = r.other OR l.y = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(other), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN reach r ON w.doc_id = r.doc_id
GROUP BY w.doc_id, n.n
"""
