"""Operator 12: a Merkle manifest of a table, and proofs for its rows.

Every row is a leaf, the SHA-256 of its fields. Each language has a tree over its
leaves in doc_id order, a top tree stands over the languages' subroots. A node is
the SHA-256 of its children's digests as hex text; two children, or one where a
level ends odd; a tree of one leaf is that leaf.

Trees are built bottom up in rounds: a task takes aligned blocks of
2^``BLOCK_BITS`` leaves and returns all nodes above them, the block's own root being a leaf of the
next round. So a round shrinks its input by that factor, however large one
language is, and no level passes one task before it has shrunk to a block.

Proofs are made by octopus multiproofs. The rows asked for are dealt to leaf
partitions (runs of ``SPAN`` places of a tree). A partition climbs from its own
places and notes at each level the children it neither has nor can make: the
least set of coordinates that proves all of its rows. It fetches these once (a
join on coordinates), makes the interiors that its rows share, and reads each
row's proof off those."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, numbered, on_workers, written

#: Leaves under one block of a round (as a power of two), places in a leaf partition.
BLOCK_BITS, SPAN = 12, 5000

#: The tree over the languages' subroots (languages are numbered from 0).
TOP = -1

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields one after the other, each its UTF-8 byte count,
    a colon and itself, or a dash for null."""
    shown = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")),
                        F.lit("-")) for c in fields]
    return F.sha2(F.concat(*shown), 256)


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(0, n - 1).bit_length()


def block_nodes(table: pa.Table, bits: int) -> pa.Table:
    """All nodes above the leaves of one block (rows tree, place, digest, and n,
    the tree's number of nodes at this level), up to ``bits`` levels."""
    order = np.argsort(table.column("place").to_numpy(), kind="stable")
    digests = table.column("digest").to_pylist()
    row = [digests[i] for i in order]
    tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
    first = table.column("place")[int(order[0])].as_py()
    level, up, places, out = 0, [], [], []
    for level in range(1, min(bits, depth(n)) + 1):
        row, first = [parent(row[i:i + 2]) for i in range(0, len(row), 2)], first // 2
        up += [level] * len(row)
        places += range(first, first + len(row))
        out += row
    return pa.table([pa.array([tree] * len(out), pa.int64()), pa.array(up, pa.int32()),
                     pa.array(places, pa.int64()), pa.array(out, pa.binary())],
                    names=["tree", "level", "place", "digest"])


def tree_nodes(leaves: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """All nodes (tree, level, place, digest) of the trees over ``leaves`` (tree,
    place, digest, n: the tree's leaves), the leaves being level 0."""
    now, base = leaves.select("tree", "place", "digest", "n"), 0
    out = now.select("tree", F.lit(0).alias("level"), "place", "digest")
    while True:
        wide = now.where("n > 1")
        if wide.isEmpty():
            return out
        new = written(wide.groupBy("tree", F.expr(f"place div {1 << bits}").alias("block")).applyInArrow(
            lambda t: block_nodes(t, bits), "tree long, level int, place long, digest binary"), "nodes")
        out = out.unionByName(new.withColumn("level", F.col("level") + base))
        # What stands ``bits`` levels up goes on; lower trees have ended.
        n = wide.groupBy("tree").agg(F.expr(f"(max(n) + {(1 << bits) - 1}) div {1 << bits}").alias("n"))
        now = new.where(F.col("level") == bits).join(n, "tree").select("tree", "place", "digest", "n")
        base += bits


def missing(places: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The coordinates (level, place) that a holder of the leaves at ``places``
    lacks for the proofs of them all in a tree of n leaves."""
    known, level, out = np.unique(places), 0, []
    while n > 1:
        up = np.unique(known >> 1)
        children = np.concatenate([2 * up, 2 * up + 1])
        lacks = np.setdiff1d(children[children < n], known)
        out += [(level, int(p)) for p in lacks]
        known, n, level = up, (n + 1) // 2, level + 1
    return out


def interiors(have: dict[tuple[int, int], bytes], places: np.ndarray, n: int) -> None:
    """Add to the nodes at hand all those above ``places``."""
    known, level = np.unique(places), 0
    while n > 1:
        known = np.unique(known >> 1)
        for p in known.tolist():
            have[level + 1, p] = parent([have[level, c] for c in (2 * p, 2 * p + 1) if c < n])
        n, level = (n + 1) // 2, level + 1


def path(have: dict[tuple[int, int], bytes], place: int, n: int) -> list[tuple[bytes | None, bool]]:
    """One proof: at each level the sibling (None: there is none) and whether it
    stands left."""
    out, level = [], 0
    while n > 1:
        s = place ^ 1
        out.append((have[level, s] if s < n else None, s < place))
        place, n, level = place >> 1, (n + 1) // 2, level + 1
    return out


def fold(digest: bytes, proof: list[tuple[bytes | None, bool]]) -> bytes:
    """The root that a leaf and its proof lead to."""
    for sibling, left in proof:
        digest = parent([digest] if sibling is None else [sibling, digest] if left else [digest, sibling])
    return digest


def _wanted(table: pa.Table) -> pa.Table:
    """The coordinates that a leaf partition fetches, in its tree and the top one."""
    tree, part, n, trees = (table.column(c)[0].as_py() for c in ("tree", "part", "n", "trees"))
    rows = [(TOP, *x) for x in missing(np.array([tree]), trees)]
    rows += [(tree, *x) for x in missing(table.column("place").to_numpy(), n)]
    cols = [[tree] * len(rows), [part] * len(rows), *(zip(*rows) if rows else ([], [], []))]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                    names=["tree", "part", "in_tree", "level", "place"])


def _proved(asked: pa.Table, got: pa.Table, with_proof: bool) -> pa.Table:
    """Proofs of a leaf partition's rows, from what it has and what it fetched."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    if with_proof:
        names, kinds = [*names, "proof"], [*kinds, pa.list_(pa.string())]
    out = []
    if asked.num_rows:
        tree, n, trees = (asked.column(c)[0].as_py() for c in ("tree", "n", "trees"))
        places, leaves = asked.column("place").to_numpy(), asked.column("digest").to_pylist()
        have, top = {}, {}
        for t, level, place, digest in zip(*(got.column(c).to_pylist() for c in ("in_tree", "level", "at", "node"))):
            (top if t == TOP else have)[level, place] = digest
        have.update(((0, int(p)), d) for p, d in zip(places, leaves))
        interiors(have, places, n)
        subroot = have[depth(n), 0]
        top[0, tree] = subroot
        interiors(top, np.array([tree]), trees)
        root, above = top[depth(trees), 0], path(top, tree, trees)
        for i, place, leaf, other in zip(asked.column("doc_id").to_pylist(), places.tolist(), leaves,
                                         asked.column("shown").to_pylist()):
            proof = path(have, place, n) + above
            siblings = [s.hex() for s, _ in proof if s is not None]
            folded = fold(other, proof)
            row = (i, leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256("".join(siblings).encode()).hexdigest(),
                   folded.hex(), folded == root)
            out.append((*row, siblings) if with_proof else row)
    cols = list(zip(*out)) or [[] for _ in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


class Manifest:
    """The trees over ``docs`` (doc_id, source, lang, n_chars, text).

    Rows that share a doc_id stand in the order of their digests; a null doc_id
    comes first, a null language is one of its own and comes first."""

    def __init__(self, docs: DataFrame, changed: Column | None = None, bits: int = BLOCK_BITS):
        """``changed``: which rows are shown with one more in n_chars when their
        proofs are tried (default: none)."""
        on_workers(docs.sparkSession)
        docs = docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS])
        leaf = leaf_digest([F.col(c) for c in FIELDS])
        changed = F.lit(False) if changed is None else F.coalesce(changed, F.lit(False))
        shown = leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
        leaves = docs.select("doc_id", "lang", F.unhex(leaf).alias("digest"),
                             F.when(changed & F.col("n_chars").isNotNull(), F.unhex(shown)).alias("shown"))
        leaves = written(leaves, "leaves")
        langs = numbered(leaves.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), [F.col("lang").asc_nulls_first()],
                         "langs", number="tree")
        self.trees = langs.count()
        order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")]
        rows = numbered(leaves, order, "order", within=["lang"], number="place")
        langs = langs.select(F.col("lang").alias("tree_lang"), "n", "tree")
        rows = rows.join(langs, F.col("lang").eqNullSafe(F.col("tree_lang")))
        self.leaves = written(rows.select("tree", "place", "n", "doc_id", "digest",
                                          F.coalesce("shown", "digest").alias("shown")), "placed")
        nodes = tree_nodes(self.leaves, bits)
        heads = langs.select("tree", "n").join(nodes, "tree").where(
            "place = 0 and level = if(n = 1, 0, length(bin(n - 1)))")
        heads = heads.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "digest",
                             F.lit(self.trees).cast("long").alias("n"))
        self.nodes = nodes.unionByName(tree_nodes(written(heads, "heads"), bits))

    def prove(self, asked: DataFrame | None = None, span: int = SPAN, with_proof: bool = False) -> DataFrame:
        """Per row asked for (rows of ``leaves``; default all): doc_id, leaf,
        subroot, root, proof_sha256, folded_root, verified and, with
        ``with_proof``, the siblings from the leaf up to the root."""
        asked = (self.leaves if asked is None else asked).withColumns(
            {"part": F.expr(f"place div {span}"), "trees": F.lit(self.trees).cast("long")})
        by_part = asked.groupBy("tree", "part")
        wanted = by_part.applyInArrow(_wanted, "tree long, part long, in_tree long, level int, place long")
        nodes = self.nodes.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("place").alias("at"),
                                  F.col("digest").alias("node"))
        got = wanted.join(nodes, F.expr("in_tree = t and level = l and place = at")).select(
            "tree", "part", "in_tree", "level", "at", "node")
        out = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
               "verified boolean" + ", proof array<string>" * with_proof)
        return by_part.cogroup(got.groupBy("tree", "part")).applyInArrow(
            lambda a, g: _proved(a, g, with_proof), out)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` proved; rows whose doc_id has a crc32 divisible
    by 7 are shown with one more in n_chars."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return Manifest(documents(spark, sf_dir), changed).prove()


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda a, c: list_reduce(list_prepend(xor(a, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                    lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents),
f AS (
  SELECT doc_id, lang,
         sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other,
         coalesce(crc % 7 = 0, false) AS changed
  FROM d),
langs AS (
  SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM f GROUP BY lang),
leaves AS (
  SELECT tree, n, doc_id, leaf, CASE WHEN changed THEN other ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM f JOIN langs ON f.lang IS NOT DISTINCT FROM langs.lang),
low AS (
  SELECT tree, 0 AS level, place, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2
  FROM low WHERE n > 1 GROUP BY tree, level, n, place // 2),
top AS (
  SELECT 0 AS level, tree AS place, digest, (SELECT count(*) FROM langs) AS n FROM low WHERE n = 1
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2
  FROM top WHERE n > 1 GROUP BY level, n, place // 2),
climb AS (
  SELECT tree, tree AS own, doc_id, leaf, 0 AS level, place, n, shown AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT CASE WHEN c.n > 1 THEN c.tree ELSE -1 END, own, c.doc_id, c.leaf,
         CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.place // 2 ELSE own END,
         CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE (SELECT count(*) FROM langs) END,
         CASE WHEN c.n = 1 THEN c.digest WHEN s.digest IS NULL THEN sha256(c.digest)
              WHEN c.place % 2 = 1 THEN sha256(s.digest || c.digest) ELSE sha256(c.digest || s.digest) END,
         proof || coalesce(s.digest, '')
  FROM climb c LEFT JOIN (SELECT tree, level, place, digest FROM low UNION ALL SELECT -1, level, place, digest FROM top) s
    ON c.n > 1 AND s.tree = c.tree AND s.level = c.level AND s.place = xor(c.place, 1)
  WHERE c.n > 1 OR c.tree >= 0)
SELECT c.doc_id, c.leaf, l.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256,
       c.digest AS folded_root, c.digest = t.digest AS verified
FROM climb c JOIN low l ON l.tree = c.own AND l.n = 1 JOIN top t ON t.n = 1
WHERE c.tree = -1 AND c.n = 1
"""
