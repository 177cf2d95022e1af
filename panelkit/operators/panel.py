"""Panel assembly.

``panel(entity, year, dims..., metrics...)`` = base view LEFT JOIN every fact
on (entity, year). Each fact is first reduced to one row per key (its latest
versions, then first non-null per column when its own key is wider), so the
joins are one-to-one by construction and the whole chain clusters on the same
(entity, year) hash partitioning.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_number
from .aggregate import first_non_null


def entity_base(registry: DataFrame, master_latest: DataFrame, entity: str = "entity_id",
                master_cols: Sequence[str] = ("year",)) -> DataFrame:
    """Every registered entity, one row per year of master data; entities
    without master data keep one row with NULL year."""
    m = master_latest.select(entity, *master_cols)
    return registry.join(m, entity, "left")


def reduce_fact(fact: DataFrame, keys: Sequence[str], order: Sequence[str],
                value_cols: Sequence[str]) -> DataFrame:
    """A4: one row per ``keys`` taking the first non-null of each column."""
    return first_non_null(fact, keys, order, value_cols)


def assemble_panel(base: DataFrame, facts: Sequence[DataFrame],
                   keys: Sequence[str] = ("entity_id", "year"),
                   numeric: Sequence[str] = ()) -> DataFrame:
    """Left-join each fact on ``keys``; only columns new to the panel are
    taken from the right side (P13). ``numeric`` columns get NaN/text-safe
    coercion (P7) once, after the joins."""
    out = base
    for f in facts:
        new = [c for c in f.columns if c not in out.columns]
        out = out.join(f.select(*keys, *new), list(keys), "left")
    if numeric:
        out = out.withColumns({c: to_number(c) for c in numeric if c in out.columns})
    return out


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int, path: str) -> DataFrame:
    """``df`` written to ``path`` in ``buckets`` by ``keys``, each one sorted file,
    and read back: joins and aggregates on these keys between frames of as many
    buckets need no exchange. The catalog forgets the table again, the files stay."""
    spark, name = df.sparkSession, f"panelkit_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))
    out = spark.table(name)
    out.schema  # resolved while the catalog knows it
    spark.sql(f"DROP TABLE {name}")
    return out


def exact_join(tables: Mapping[str, DataFrame], keys: Sequence[str], rows_of: Sequence[str] = ()) -> DataFrame:
    """The inner join of tables on the whole key, by one union and one
    exchange: each table's rows carry its bit, rows of a key meet in one
    aggregate (partial before the shuffle), and a key is kept if it has all bits.

    Columns beside the keys must differ between tables, and a table has one row a
    key; one that has more fails the job. Tables named in ``rows_of`` may have any
    number of rows a key: they only say that the key is there, as in a join whose
    fan-out is grouped away again. NULL keys join nothing."""
    union, values, single = None, [], {}
    for i, (name, df) in enumerate(tables.items()):
        cols = [] if name in rows_of else [c for c in df.columns if c not in keys]
        if clash := set(cols) & set(values):
            raise ValueError(f"columns {sorted(clash)} are in two tables")
        values += cols
        if cols:
            single[name] = 1 << i
        part = df.dropna(subset=list(keys)).select(*keys, F.lit(1 << i).cast("long").alias("_bit"), *cols)
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    # A key that is kept is in every table, so it has one row in each of the single
    # ones if it has as many rows of them as there are.
    n_single = F.count_if(F.col("_bit").bitwiseAND(F.lit(sum(single.values()))) != 0).alias("_n")
    out = union.groupBy(*keys).agg(F.bit_or("_bit").alias("_bits"), n_single, *[F.max(c).alias(c) for c in values])
    out = out.where(F.col("_bits") == (1 << len(tables)) - 1)
    failed = F.raise_error(F.lit(f"a key has two rows in one of {list(single)}")).cast("boolean")
    return out.where(F.when(F.col("_n") > len(single), failed).otherwise(True)).select(*keys, *values)


def duplicate_keys(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Keys held by more than one row, with their multiplicity."""
    return (df.groupBy(*keys).count().filter(F.col("count") > 1)
              .select(F.lit(side).alias("side"), *keys, F.col("count").alias("n_rows")))
