"""Report dispatch and batch runs.

A batch writes the panel once, runs every config against it, writes each
result and isolates failures: one failing report does not stop
the others; failures are returned, not printed."""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.sinks import output_folder, write_sections
from . import reports as R


@dataclass
class Context:
    """What reports need besides the panel: aggregation sets and contacts."""
    agg: Mapping[str, Mapping[str, str]]
    contacts: DataFrame | None = None          # one row per contact address
    contacts_joined: DataFrame | None = None   # one row per entity, '; '-joined
    extra: dict = field(default_factory=dict)


def _agg(cfg, ctx):
    a = cfg.get("agg", "full")
    return ctx.agg[a] if isinstance(a, str) else a


REPORTS: dict[str, Callable] = {
    "growth": lambda p, c, x: R.report_regional_growth(p, c, _agg(c, x)),
    "totals": lambda p, c, x: R.report_totals(p, c, _agg(c, x)),
    "single_metric": lambda p, c, x: R.report_single_metric(p, c, _agg(c, x)),
    "multi_metric": lambda p, c, x: R.report_multi_metric(p, c, _agg(c, x)),
    "entity": lambda p, c, x: R.report_entity(p, c, _agg(c, x)),
    "all_entities": lambda p, c, x: R.report_all_entities(p, c, _agg(c, x)),
    "totals_plain": lambda p, c, x: R.report_totals_plain(p, c, _agg(c, x)),
    "totals_change": lambda p, c, x: R.report_totals_change(p, c, _agg(c, x)),
    "emails": lambda p, c, x: R.report_emails(p, c, x.contacts, x.contacts_joined),
    "missing": lambda p, c, x: {"missing": R.report_missing(p, c, x.contacts_joined)},
}


def run(panel: DataFrame, cfg: Mapping, ctx: Context):
    """Dispatch on ``cfg['type']``; unknown types are an error."""
    t = cfg.get("type")
    if t not in REPORTS:
        raise ValueError(f"unknown report type {t!r}; known: {sorted(REPORTS)}")
    return REPORTS[t](panel, cfg, ctx)


def run_batch(panel: DataFrame, configs: Sequence[Mapping], ctx: Context,
              out_dir: str | None = None, select: Sequence[str] | None = None,
              stamp: _dt.datetime | None = None):
    """({(report, section): DataFrame of the written rows}, failures).

    The panel is written once to the shared folder and read by all reports;
    every section is computed once, written, and read back. One failing report
    is listed and the others go on. ``out_dir`` None: a new shared folder."""
    spark, stamp = panel.sparkSession, stamp or _dt.datetime.now()
    run_dir = shared_path(spark, "batch", uuid.uuid4().hex)
    panel.write.parquet(f"{run_dir}/panel")
    panel = spark.read.schema(panel.schema).parquet(f"{run_dir}/panel")
    out_dir = out_dir or f"{run_dir}/reports"
    written, failures = {}, []
    for cfg in configs:
        name = cfg.get("name", cfg["type"])
        if select and name not in select:
            continue
        try:
            res = run(panel, cfg, ctx)
            sections = res if isinstance(res, Mapping) else {"main": res}
            for sec, path in write_sections(sections, out_dir, output_folder(cfg, stamp)).items():
                written[name, sec] = spark.read.schema(sections[sec].schema).parquet(path)
        except Exception as e:  # noqa: BLE001 - isolate one report's failure
            failures.append((name, f"{type(e).__name__}: {e}"))
    return written, failures


def cells(report: str, section: str, df: DataFrame) -> DataFrame:
    """A section as rows (report, section, row_key, column_name, number, text);
    the first column names the row."""
    key, *rest = df.columns
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in
               ("double", "float", "integer", "long", "short", "decimal")}
    items = [F.struct(F.lit(c).alias("column_name"),
                      (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"),
                      (F.lit(None).cast("string") if c in numeric else F.col(c).cast("string")).alias("text"))
             for c in (rest or [key])]
    return df.select(F.lit(report).alias("report"), F.lit(section).alias("section"),
                     F.col(key).cast("string").alias("row_key"), F.inline(F.array(*items)))
