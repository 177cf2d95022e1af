"""Staged submissions.

A drop folder holds one sub-folder per sheet; every file in it is one
submission's rows for that sheet. CSV columns are found by the names in each
file's header: the files of a drop are grouped by their header line, and each
group is scanned once under the schema that its own header gives (all text, no
inference). A column that a file lacks is null and a violation, as is one that
the sheet doesn't know; a header that names a column twice leaves its value
open, so it is null and a violation too. The submission id is the file name, so
the sheets of one submission line up."""

from __future__ import annotations

import csv
from collections import Counter, defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of violations met while reading: those of the rules (``quality.violations``).
VIOLATIONS = "sheet string, submission_id string, row_id long, field string, rule string, value string"

#: Different header lines that one sheet of a drop may have.
MOST_HEADERS = 1000


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def _submission(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def header_names(line: str) -> list[str]:
    """The column names of a header line."""
    return [c.strip() for c in next(csv.reader([line.lstrip("\ufeff")]), [])]


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Header line -> its files. One row a file comes to the driver, as many as
    Spark's own listing of the folder holds there."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value")
    first = lines.groupBy("path").agg(F.min_by("value", F.struct("start", "at")).alias("line"))
    out: dict[str, list[str]] = defaultdict(list)
    for r in first.toLocalIterator():
        out[r.line].append(r.path)
    if len(out) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers; are these files of one sheet?")
    return dict(out)


def read_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], sheet: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of CSV files (or folders of them), columns by name.

    Rows: submission_id, _at (ascending within a file), the columns. A file
    without a line has no rows and no violation."""
    rows = spark.createDataFrame([], T.StructType([
        T.StructField("submission_id", T.StringType()), T.StructField("_at", T.LongType()), *text_schema(columns)]))
    found = spark.createDataFrame([], VIOLATIONS)
    for line, files in sorted(headers(spark, paths).items()):
        names = header_names(line)
        times = Counter(names)
        bad = [(c, "missing_header", None) for c in columns if not times[c]]
        bad += [(c, "unknown_header", c) for c in times if c not in columns]
        bad += [(c, "repeated_header", c) for c in times if c in columns and times[c] > 1]
        # Spark wants different names; what isn't taken gets one of its own.
        own = [c if c in columns and times[c] == 1 else f"_skip_{i}" for i, c in enumerate(names)]
        part = spark.read.schema(text_schema(own)).option("header", True).option("mode", "PERMISSIVE").csv(files)
        taken = [F.col(f"`{c}`") if c in own else F.lit(None).cast("string").alias(c) for c in columns]
        rows = rows.unionByName(part.select(_submission(F.col("_metadata.file_path")).alias("submission_id"),
                                            F.monotonically_increasing_id().alias("_at"), *taken))
        if bad:
            names_of = spark.createDataFrame([(f,) for f in files], "path string").select(
                _submission(F.col("path")).alias("submission_id"))
            kinds = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(k).alias("rule"),
                                       F.lit(v).cast("string").alias("value")) for c, k, v in bad])
            found = found.unionByName(names_of.select("submission_id", F.explode(kinds).alias("v")).select(
                F.lit(sheet).alias("sheet"), "submission_id", F.lit(1).cast("long").alias("row_id"),
                "v.field", "v.rule", "v.value"))
    return rows, found


def read_drop(spark: SparkSession, drop: str, sheets: Mapping[str, Sequence[str]],
              fmt: str = "csv") -> tuple[dict[str, DataFrame], DataFrame]:
    """S1 over many submissions: ({sheet: DataFrame(submission_id, row_id,
    columns...)}, violations of the headers). Every value is text and is
    validated before casting. ``ingest(..., found=violations)`` holds back the
    submissions whose header doesn't fit."""
    out, found = {}, spark.createDataFrame([], VIOLATIONS)
    for sheet, cols in sheets.items():
        folder = f"{drop.rstrip('/')}/{sheet}/"
        if fmt == "csv":
            df, bad = read_csv(spark, [folder], cols, sheet)
            found = found.unionByName(bad)
        else:
            df = spark.read.schema(text_schema(cols)).format(fmt).load(folder)
            df = df.select(_submission(F.col("_metadata.file_path")).alias("submission_id"),
                           F.monotonically_increasing_id().alias("_at"), *cols)
        # One file is one submission's sheet: its rows are numbered as in the
        # file, the header being row 1.
        line = F.row_number().over(Window.partitionBy("submission_id").orderBy("_at")) + 1
        out[sheet] = df.select("submission_id", line.cast("long").alias("row_id"), *cols)
    return out, found


def read_sheets(spark: SparkSession, drop: str, sheets: Mapping[str, Sequence[str]],
                fmt: str = "csv", strict: bool = True) -> dict[str, DataFrame]:
    """``read_drop`` for drops whose headers fit: ``strict`` refuses others, without
    it missing columns are null and unknown ones are left out."""
    out, found = read_drop(spark, drop, sheets, fmt)
    if strict and (first := found.first()):
        raise ValueError(f"{first.sheet}/{first.submission_id}: {first.rule} {first.field!r}")
    return out
