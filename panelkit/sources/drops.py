"""Tables that grow drop by drop.

A drop is one delivery of submissions. It claims a number, and for what it
numbers (rows, registry ids, dictionary ids) a range that starts where the last
one ended. Its rows go to a folder of its own in each table, and readers see
them once the drop is marked done. A drop that is tried again under its id gets
the same number and ranges and writes the same folders, one that is done is left
as it is: no row comes twice, no id is used twice or left out.

Claims are files created with "must not exist", so two drivers never get the same
one. They hold one line each; the driver lists one file a drop.

``LatestTable`` keeps the newest row of each key (W1) as drops arrive: keys are
dealt to a fixed number of parts by a hash, and a drop only rewrites the parts
that its keys touch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.latest import latest_by
from ..operators.quality import check_whitelist


class Folder:
    """Small files in a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self.fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at("")))

    def create(self, name: str, text: str) -> bool:
        """Whether this call made the file (False: it was there)."""
        try:
            out = self.fs.create(self._at(name), False)
        except Exception:
            if self.fs.exists(self._at(name)):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        f = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        finally:
            f.close()


class DropStore:
    """The tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, *parts: str) -> Folder:
        return Folder(self.spark, "/".join([self.root, "_drops", *parts]))

    def claim(self, drop: str) -> int:
        """The number of a drop, the same whenever it is asked for."""
        folder = self._folder("claims")
        known: dict[str, str] = {}
        while True:
            for name in folder.names():
                if name not in known:
                    known[name] = folder.read(name)
            # A file that its driver left empty belongs to no drop.
            mine = [int(n) for n, d in known.items() if d == drop]
            if mine:
                return min(mine)
            folder.create(f"{len(known) + 1:09d}", drop)

    def range(self, kind: str, number: int, count: int, floor: int = 0) -> int:
        """What drop ``number`` numbers ``count`` things of ``kind`` after: the
        end of the last range claimed before, ``floor`` at least."""
        folder = self._folder("ranges", kind)
        while True:
            names = folder.names()
            rows = [tuple(map(int, folder.read(n).split())) for n in names]
            for owner, after, n in (r for r in rows if r):
                if owner == number:
                    if n != count:
                        raise ValueError(f"drop {number} had {n} of {kind!r} and now has {count}")
                    return after
            after = max([floor, *[a + n for _, a, n in (r for r in rows if r)]])
            if folder.create(f"{len(names) + 1:09d}", f"{number} {after} {count}"):
                return after

    def append(self, df: DataFrame, table: str, number: int,
               whitelist: Mapping[str, Sequence[str]] | None = None) -> str:
        """The drop's rows of a table, after the whitelist check."""
        if whitelist is not None:
            check_whitelist(df, table, whitelist)
        path = f"{self.root}/{table}/drop={number}"
        df.write.mode("overwrite").parquet(path)
        return path

    def finish(self, number: int, tables: Sequence[str]) -> None:
        """From now on the drop is seen."""
        self._folder("done").create(f"{number:09d}", "\n".join(tables))

    def done(self, number: int) -> list[str] | None:
        """The tables of a finished drop."""
        folder, name = self._folder("done"), f"{number:09d}"
        return folder.read(name).split("\n") if name in folder.names() else None

    def drops(self, table: str) -> list[int]:
        """The finished drops that have the table, in the order of their numbers."""
        folder = self._folder("done")
        return [int(n) for n in folder.names() if table in folder.read(n).split("\n")]

    def read(self, table: str, schema: T.StructType | str | None = None,
             drops: Sequence[int] | None = None) -> DataFrame | None:
        """The rows of the finished drops (or those listed); None: there are none."""
        paths = [f"{self.root}/{table}/drop={n}" for n in (self.drops(table) if drops is None else drops)]
        if not paths:
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths)


class LatestTable:
    """W1 kept up to date: the newest row of each key of a table of ``store``.

    ``order`` (descending columns) ends in the ingest sequence. ``parts`` is fixed
    when the table is made: it bounds what a small drop rewrites and the list of
    parts on the driver."""

    def __init__(self, store: DropStore, table: str, keys: Sequence[str], order: Sequence[str], parts: int = 256):
        self.store, self.table, self.keys, self.order, self.parts = store, table, list(keys), list(order), parts
        self.path = f"{store.root}/_latest/{table}"
        self.folds = Folder(store.spark, f"{self.path}/folds")

    def _newest(self, df: DataFrame) -> DataFrame:
        return latest_by(df, self.keys, [F.col(c).desc() for c in self.order])

    def _current(self) -> dict[int, int]:
        """The drop that last rewrote each part."""
        out: dict[int, int] = {}
        for name in self.folds.names():
            out.update((int(p), int(name)) for p in self.folds.read(name).split())
        return out

    def _read(self, parts: Mapping[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/drop={n}/part={p}" for p, n in sorted(parts.items())]
        return self.store.spark.read.option("basePath", f"{self.path}").parquet(*paths).drop("drop") if paths else None

    def fold(self) -> list[int]:
        """Take in the finished drops that aren't yet; returns their numbers."""
        seen = {int(n) for n in self.folds.names()}
        new = [n for n in self.store.drops(self.table) if n not in seen]
        for number in new:
            self._fold(number)
        return new

    def _fold(self, number: int) -> None:
        spark = self.store.spark
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        fresh = self._newest(self.store.read(self.table, drops=[number])).withColumn("part", part)
        work = f"{self.path}/_fresh/{number}"
        fresh.write.mode("overwrite").parquet(work)
        fresh = spark.read.schema(fresh.schema).parquet(work)
        touched = sorted(r.part for r in fresh.select("part").distinct().collect())  # at most ``parts``
        old = self._read({p: n for p, n in self._current().items() if p in set(touched)})
        rows = fresh if old is None else self._newest(fresh.unionByName(old))
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/drop={number}")
        self.folds.create(f"{number:09d}", " ".join(map(str, touched)))

    def read(self) -> DataFrame | None:
        """The newest row of each key; None: no drop has been taken in."""
        out = self._read(self._current())
        return None if out is None else out.drop("part")
