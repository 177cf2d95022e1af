"""Connected components of an edge list, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root) for every node of an edge, root the least node of its
    component. Each round takes the least root around a node and then the root
    of that root, so a chain of n edges takes about log2(n) rounds; roots are
    checkpointed each round."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    e = e.union(e.select("y", "x")).where("x <> y").distinct().checkpoint()
    roots = e.groupBy("x").agg(F.least("x", F.min("y")).alias("root")).withColumnRenamed("x", "node").checkpoint()
    while True:
        around = e.join(roots, e["y"] == roots["node"]).groupBy("x").agg(F.min("root").alias("near"))
        # A node tells its own root too what it has found, so that whole trees move.
        hook = roots.join(around, roots["node"] == around["x"]).select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        moved = hook.where("root < old").groupBy("old").agg(F.min("root").alias("to")).withColumnRenamed("old", "from")
        hook = hook.join(moved, hook["old"] == moved["from"], "left").select(
            "node", "old", F.least("root", F.coalesce("to", "root")).alias("root"))
        up = hook.select(F.col("node").alias("up"), F.col("root").alias("above"))
        new = hook.join(up, hook["root"] == up["up"], "left").select(
            "node", "old", F.least("root", F.coalesce("above", "root")).alias("root")).checkpoint()
        roots = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return roots
