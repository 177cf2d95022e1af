"""Continuous ingest (R17 on arrival) with Structured Streaming.

New submission files landing in ``<drop>/<sheet>/`` are picked up by the file
source; every micro-batch reads its files by their own headers, is validated,
offending submissions are held back (their violations appended to a violations
table) and the clean rows are typed, split and appended. The stream's checkpoint
lives under the shared checkpoint folder, so a restarted job resumes where it
stopped and a lost executor only re-runs its tasks (appends are idempotent per
batch id)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import reshape as RP
from ..session import shared_path
from ..sources.staged import read_csv

#: Files of a micro-batch: their names come to the driver.
MOST_FILES = 1000


def file_stream(spark: SparkSession, drop: str, sheet: str) -> DataFrame:
    """The paths of new files (their contents are not read here)."""
    schema = "path string, modificationTime timestamp, length long, content binary"  # of this source
    return (spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", MOST_FILES)
            .load(f"{drop.rstrip('/')}/{sheet}/").select("path"))


def start_ingest(spark: SparkSession, drop: str, sheet: str, columns: Sequence[str],
                 rules: Sequence[Q.Rule], tables: Mapping[str, Sequence[str]],
                 types: Mapping[str, str], root: str, checkpoint: str | None = None,
                 available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    checkpoint = checkpoint or shared_path(spark, "streams", f"ingest_{sheet}")
    root = root.rstrip("/")

    def batch(new: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in new.collect()]
        if not paths:
            return
        df, found = read_csv(spark, paths, columns, sheet)
        # row ids are given per micro-batch (not available on the stream itself)
        df = df.drop("_at").withColumns({"row_id": F.monotonically_increasing_id(), "batch_id": F.lit(batch_id)})
        viol = Q.violations(df, rules, ["submission_id", "row_id"], sheet).unionByName(found)
        viol = viol.withColumn("batch_id", F.lit(batch_id))
        bad = viol.select("submission_id").distinct()
        clean = RP.typed(Q.gate(df, bad, ["submission_id"]), types)
        # a retried batch id overwrites its own partition: idempotent appends
        viol.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch_id").parquet(f"{root}/violations")
        for table, df_t in RP.split(clean, tables, keep=["submission_id", "row_id", "batch_id"]).items():
            df_t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                .partitionBy("batch_id").parquet(f"{root}/{table}")

    w = (file_stream(spark, drop, sheet).writeStream
         .foreachBatch(batch).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
