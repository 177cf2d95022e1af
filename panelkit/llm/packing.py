"""Operator 4: shards by best-fit-decreasing bin packing.

Documents with equal texts form indivisible groups. Groups are taken by
descending size; each enters the bin whose remaining capacity is the tightest
that still holds it, found in a balanced tree of remaining capacities.

Best fit sees only sizes, so the packing runs on the histogram of group sizes
(distinct sizes add up to at most the total bytes, so there are at most
sqrt(2 x bytes) of them; groups themselves never reach the driver): all groups
of one size that fit a bin are placed at once. The result, ranges of group
ranks within each size, is joined back to the groups."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, numbered, written

SHARDS = 16


class CapacityTree:
    """Balanced tree of (remaining capacity, bin), two levels of sorted nodes
    that split when full."""

    FULL = 256

    def __init__(self):
        self.nodes: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []

    def add(self, left: int, bin_: int) -> None:
        item = (left, bin_)
        if not self.nodes:
            self.nodes, self.tops = [[item]], [item]
            return
        k = min(bisect_left(self.tops, item), len(self.nodes) - 1)
        node = self.nodes[k]
        node.insert(bisect_left(node, item), item)
        if len(node) > self.FULL:
            half = len(node) // 2
            self.nodes[k:k + 1] = [node[:half], node[half:]]
            self.tops[k:k + 1] = [node[half - 1], node[-1]]
        else:
            self.tops[k] = node[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin with at least ``size`` left."""
        k = bisect_left(self.tops, (size, -1))
        return None if k == len(self.nodes) else self._pop(k, bisect_left(self.nodes[k], (size, -1)))

    def take_roomiest(self) -> tuple[int, int]:
        return self._pop(len(self.nodes) - 1, len(self.nodes[-1]) - 1)

    def _pop(self, k: int, at: int) -> tuple[int, int]:
        node = self.nodes[k]
        item = node.pop(at)
        if node:
            self.tops[k] = node[-1]
        else:
            del self.nodes[k], self.tops[k]
        return item


def best_fit(sizes, capacity: int, bins: int | None = None):
    """Best-fit-decreasing over (size, number of groups) in descending size.

    Yields (size, first rank, end rank, bin): groups of that size with ranks in
    the range go to the bin. Without ``bins``, new bins are opened as needed
    and a group larger than the capacity gets a bin of its own; with it, what
    fits nowhere goes to the bin with most room left (capacities may then run
    below zero)."""
    tree, opened = CapacityTree(), 0
    if bins is not None:
        for opened in range(bins):
            tree.add(capacity, opened)
    for size, count in sizes:
        rank = 0
        while rank < count:
            got = tree.take(size)
            if got is None:
                if bins is None:
                    got, opened = (max(capacity, size), opened), opened + 1
                else:
                    got = tree.take_roomiest()
            left, bin_ = got
            n = min(count - rank, max(1, left // size))
            yield size, rank, rank + n, bin_
            rank += n
            tree.add(left - n * size, bin_)


def pack(df: DataFrame, key: str, size: str, shards: int | None = None,
         capacity: int | None = None) -> DataFrame:
    """``df`` with ``shard``: rows of equal ``key`` (null is a key) stay together.
    A column named shard gives way.

    Give a number of shards (each then holds about an equal part of all sizes)
    or the capacity of one (then as few shards as best fit needs). A group
    larger than a shard's part is never split; its shard then holds little
    else. Sizes must be positive."""
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = df.sparkSession
    df = df.drop("shard")
    groups = written(df.groupBy(F.col(f"`{key}`").alias("group_key"))
                     .agg(F.sum(f"`{size}`").cast("long").alias("group_size")), "groups")
    histogram = groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("n"))
    histogram = histogram.orderBy(F.desc("group_size"))
    rows = [(r[0], r[1]) for r in histogram.toLocalIterator()]
    total = sum(s * n for s, n in rows)
    if capacity is None:
        capacity = -(-total // shards)
    ranges = spark.createDataFrame(list(best_fit(rows, capacity, shards)) or [],
                                   "group_size long, first_rank long, end_rank long, shard int")
    # Ranks within a size, without one task for a frequent size.
    ranked = numbered(groups, [F.col("group_size"), F.col("group_key").asc_nulls_first()], "ranked",
                      within=["group_size"], number="rank")
    placed = ranked.join(ranges, "group_size").where(
        "rank >= first_rank and rank < end_rank").select(
            F.col("group_key").alias("__group_key"), "shard")
    return df.join(placed, df[key].eqNullSafe(placed["__group_key"])).drop("__group_key")


def op4_best_fit_shards(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards of near equal bytes, equal texts together.

    Null texts have no bytes (size 1) and are grouped with empty ones. Slots
    number each shard's rows by doc_id. The law is ``bytes``; grown_shard is
    null."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents(spark, sf_dir).select(
        "doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.md5(raw).alias("text_key"), F.monotonically_increasing_id().alias("row"))
    docs = written(docs, "sizes")
    packed = pack(docs, "text_key", "size", shards=SHARDS)
    slots = numbered(packed, [F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("row")],
                     "slots", within=["shard"], number="slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
