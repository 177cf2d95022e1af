"""Sinks (S6, S7, S9, S10).

Appends are plain Parquet appends (each task commits atomically, so a lost
executor only re-runs its task); reports are written one folder per section.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import sanitize_name
from ..operators.quality import check_whitelist


def append_table(df: DataFrame, root: str, table: str,
                 whitelist: Mapping[str, Sequence[str]] | None = None,
                 partition_by: Sequence[str] = ()) -> str:
    """Append after the table/column whitelist check."""
    if whitelist is not None:
        check_whitelist(df, table, whitelist)
    path = f"{root.rstrip('/')}/{table}"
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def append_raw(df: DataFrame, root: str, table: str) -> str:
    """Append without a whitelist."""
    return append_table(df, root, table)


def write_sections(result: DataFrame | Mapping[str, DataFrame], out_dir: str, name: str,
                   fmt: str = "parquet") -> dict[str, str]:
    """One folder ``out_dir/name/section`` per section, under its whole
    (sanitised) name. Names that would share a folder, and folders that are
    there already, are errors: nothing is overwritten."""
    sections = dict(result) if isinstance(result, Mapping) else {name: result}
    folders: dict[str, str] = {}
    for sec in sections:
        other = folders.setdefault(sanitize_name(sec, None), sec)
        if other != sec:
            raise ValueError(f"sections {other!r} and {sec!r} would share a folder")
    top = f"{out_dir.rstrip('/')}/{sanitize_name(name, None)}"
    paths = {sec: f"{top}/{folder}" for folder, sec in folders.items()}
    for sec, path in paths.items():
        sections[sec].write.mode("errorifexists").format(fmt).save(path)
    return paths


#: Rows of a section's file at most (a section with more has several files).
FILE_ROWS = 1_000_000


def write_each(df: DataFrame, by: str, path: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """S9 for very many sections: one folder under ``path`` for each value of
    ``by``, in one job. Rows are rebalanced by the value, so a small section is one
    file and a section that holds much of all rows is cut over several tasks and
    files; nothing passes one task whole. A row without a value is an error.

    Returns the manifest, read back from what was written: (section, folder,
    n_files, n_rows). A folder is named as Spark names partitions, which escapes
    whatever a file name can't hold, so no two values share one."""
    value = F.coalesce(F.col(f"`{by}`").cast("string"), F.raise_error(F.lit(f"a row has no {by}")).cast("string"))
    out = df.withColumn("section", value).drop(by).hint("rebalance", "section")
    (out.write.mode("errorifexists").option("maxRecordsPerFile", file_rows).partitionBy("section").parquet(path))
    return sections_manifest(df.sparkSession, path)


def read_each(spark: SparkSession, path: str) -> DataFrame:
    """All sections that ``write_each`` wrote, with their value (``section``)."""
    kept = {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}  # "007" stays text
    old = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        return spark.read.parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def sections_manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = read_each(spark, path).select("section", F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("section").agg(
        F.regexp_extract(F.first("file"), r"([^/]+)/[^/]+$", 1).alias("folder"),
        F.count_distinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_rows"))


#: What a report's folder name shows of its config, in this order.
NAME_FIELDS = ("name", "type", "metric", "entity", "year", "years")


def output_folder(cfg: Mapping, at: _dt.datetime, fields: Sequence[str] = NAME_FIELDS) -> str:
    """Folder name of one run of a report: ``field=value`` for every listed
    field that the config has, the minute, and a digest of the whole config,
    so that two configs never share a folder."""
    def shown(v) -> str:
        return ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    digest = hashlib.sha256(json.dumps(cfg, sort_keys=True, default=str).encode()).hexdigest()[:10]
    parts = [f"{f}={shown(cfg[f])}" for f in fields if cfg.get(f) not in (None, "", [])]
    return sanitize_name(";".join([*parts, f"at={at:%Y%m%dT%H%M}", digest]), None)
