"""Session helpers: building a local session for tests/bench and finding the
shared folder used for lineage cuts and appended tables."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "panelkit", extra: dict | None = None) -> SparkSession:
    """Local session with the settings the library is designed around.

    On a cluster the session is created by the platform; only the SQL
    settings below matter there (AQE on, skew join on, UI off here)."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is read, never
    overridden. Only in local mode, where all tasks share the driver's disk, a
    scratch folder is made if it is unset; on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        d = tempfile.mkdtemp(prefix="panelkit-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written tables)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([root, *parts])


def together(spark: SparkSession, tasks: Sequence[Callable[[], object]]) -> list:
    """Results of independent tasks that run Spark jobs, in their order: the small jobs
    of one leave cores free, which the others' use meanwhile. All end before the first
    error is raised."""
    if len(tasks) < 2:
        return [t() for t in tasks]
    with ThreadPoolExecutor(len(tasks)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]
    return [r.result() for r in running]
