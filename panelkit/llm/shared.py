"""Helpers shared by the operators: written tables in the shared folder,
Arrow passes that add columns to a frame, and gapless numbering."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path

#: Characters of text handled at once inside a task.
SLICE_CHARS = 1 << 20


def on_workers(spark: SparkSession) -> None:
    """Make this package importable in Python workers: where their search path
    (PYTHONPATH) doesn't have it, Spark ships it to them once a session."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    if top in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    context = spark.sparkContext
    if getattr(context, "_panelkit_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="panelkit-"), "panelkit_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(full := os.path.join(folder, n), os.path.relpath(full, top))
    context.addPyFile(path)
    context._panelkit_shipped = True


_KEPT: dict[object, object] = {}


def kept_in_worker(key: object, make: Callable[[], object]) -> object:
    """``make()``, kept in this Python worker from task to task under ``key``.
    Workers outlive stages, so only one thing is kept: what another operator
    needed before goes when the next one asks."""
    if key not in _KEPT:
        nothing_kept()
        _KEPT[key] = make()
    return _KEPT[key]


def nothing_kept() -> None:
    """For tasks that keep nothing: drop what is kept, and give its memory back,
    which the allocators would hold as long as the worker lives."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Give the memory that nothing uses any more back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def sparing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that ends by giving its memory back: a worker that waits for
    its next task then holds none beside the JVM's."""
    def spare(batches):
        yield from run(batches)
        give_back()
    return spare


def packed(docs: DataFrame, apart: Sequence[str]) -> DataFrame:
    """The columns ``apart`` as they are and the others in one, ``__row``, so that
    added columns may have any names; ``unpacked`` gives ``columns`` back."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in apart]
    return docs.select(F.struct(F.lit(True).alias("__any"), *rest).alias("__row"), *apart)


def unpacked(rows: DataFrame, columns: Sequence[str], apart: Sequence[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in apart else F.col("__row").getField(c).alias(c) for c in columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans
    start from files that outlive any executor, and row positions, range
    bounds and task numbers in it are fixed."""
    spark = df.sparkSession
    on_workers(spark)
    path = shared_path(spark, "llm", f"{what}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(lengths: Sequence[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``most`` characters (one row at least)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def add_columns(df: DataFrame, text: str, fields: str,
                make: Callable[[], Callable[[list[str]], dict[str, object]]],
                keep: Sequence[str] | None = None) -> DataFrame:
    """One Arrow pass over ``df`` that adds the columns ``fields`` (a DDL
    string) computed from the text column. ``make()`` runs once a task and
    returns a function from a list of texts (null: empty) to the columns.

    ``keep`` names the input columns to carry on (default: all); an input
    column named like an added one gives way to it."""
    on_workers(df.sparkSession)
    added = T.StructType.fromDDL(fields)
    names = [f.name for f in added]
    carried = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in carried] + list(added))
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(added)
    # The text goes to the worker once, as the last column, carried on or not.
    sent = [*[c for c in carried if c != text], text]
    at_sent = [sent.index(c) for c in carried]

    def run(batches):
        fn = make()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            lengths = texts.nbytes // max(1, len(texts))
            step = max(1, SLICE_CHARS // max(1, lengths))
            at = 0
            while at < b.num_rows:
                part = [x or "" for x in texts.slice(at, step).to_pylist()]
                done = 0
                for lo, hi in slices([len(x) for x in part]):
                    cols = fn(part[lo:hi])
                    out = [_array(cols[f.name], f.type) for f in arrow]
                    rows = b.slice(at + lo, hi - lo)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(i) for i in at_sent] + out,
                        names=[*carried, *names])
                    done = hi
                at += done

    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(sparing(run), schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values).cast(kind)
    return pa.array(values, type=kind)


def numbered(df: DataFrame, order: Sequence[Column], what: str, within: Sequence[str] = (),
             number: str = "number") -> DataFrame:
    """Gapless numbers from 0 in the order ``order`` (restarting for each value
    of ``within``, which must lead the order), without one task for all rows.

    Range partitions are sorted and written once; each partition's row counts
    (one row per partition and value of ``within``) become offsets. Rows equal
    in ``order`` are numbered in any order, so end it in a unique column.
    Extra columns ``__part`` and ``__pos`` never leave."""
    keys = list(within)
    cut = (df.repartitionByRange(*order).sortWithinPartitions(*order)
           .withColumn("__id", F.monotonically_increasing_id())
           .withColumn("__part", F.shiftright("__id", 33).cast("int"))
           .withColumn("__pos", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id"))
    cut = written(cut, what)
    from pyspark.sql import Window
    counts = cut.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"),
                                              F.min("__pos").alias("__first"))
    w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        (F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__first")).alias("__offset"))
    # One row per partition and key: its size is the number of tasks, not of rows.
    match = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = cut.join(F.broadcast(offsets), match)
    return out.select(*df.columns, (F.col("__pos") + F.col("__offset")).cast("long").alias(number))
