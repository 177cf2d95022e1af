"""Newest version per key (W1) and keep-the-max-row.

Append-only tables hold every submitted version of a record; readers want the
newest one per key. ``latest_by`` is the Spark form of
``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY datum DESC, seq DESC) = 1``:
Spark plans it with a partial WindowGroupLimit before the shuffle, so only one
row per key and map task crosses the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col


def _order(order: Sequence[str | Column]) -> list[Column]:
    out = []
    for o in order:
        out.append(col(o))
    return out


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per ``keys``: the first under ``order`` (give DESC columns).

    ``order`` must end in a unique column (the ingest sequence or primary
    key), otherwise ties make the pick arbitrary."""
    if not order:
        raise ValueError("latest_by needs an explicit order ending in a unique column")
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return (df.withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") == 1).drop("_rn"))


def latest_max_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Same rows as ``latest_by`` with ascending ``order`` columns taken as the
    max (A15, ``HAVING ts = MAX(ts)`` with a tie-break), as an aggregate."""
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    ordkey = F.struct(*[F.col(c) for c in order])
    out = df.groupBy(*keys).agg(F.max_by(packed, ordkey).alias("_row"))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in others])
