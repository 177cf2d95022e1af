"""Scans of the stored tables.

Every read is a lazy Parquet scan, so column pruning (S3) and predicate
pushdown (S4, S5) reach the file reader through Catalyst."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy, named access to one folder of Parquet tables.

    Every access lists the files anew, so rows appended meanwhile are seen."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return read_table(self.spark, self.root, name)
        raise AttributeError(name)

    @cached_property
    def names(self) -> tuple[str, ...]:
        return DRIVER_TABLES

    def register_views(self) -> None:
        """Every table as a temp view for ``spark.sql`` users."""
        for n in DRIVER_TABLES:
            read_table(self.spark, self.root, n).createOrReplaceTempView(n)
