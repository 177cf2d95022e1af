"""Grouped aggregation with a metric -> kind config (A1-A8, A13, A16) and the
long form ``(group..., year, metric, kind, value)`` every report is built on.

Kinds follow pandas: ``sum`` of nothing is 0 (A2), ``mean`` skips missing
values and is missing when all are (A3). Values are added as they are; a
kind made by ``exact`` declares how many decimal places its metric has, and the
sum then does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import mean, sum_or_zero
from ..session import ensure_checkpoint_dir

KINDS = ("sum", "mean")


class exact(str):
    """A kind whose metric has at most ``scale`` decimal places."""

    scale: int

    def __new__(cls, kind: str, scale: int):
        out = super().__new__(cls, kind)
        out.scale = scale
        return out


def check_metrics(spec: Mapping[str, str], df: DataFrame | None = None) -> None:
    for m, k in spec.items():
        if k not in KINDS:
            raise ValueError(f"metric {m!r}: unknown aggregation {k!r}")
        if df is not None and m not in df.columns:
            raise ValueError(f"metric {m!r} is not a column of the panel")


def choose_metrics(spec: Mapping[str, str], metric: str | None = None,
                   metrics: Sequence[str] | str | None = None) -> dict[str, str]:
    """One metric, a list, or all of the config; unknown -> ValueError."""
    if metric:
        chosen = [metric]
    elif metrics:
        chosen = [metrics] if isinstance(metrics, str) else list(metrics)
    else:
        chosen = list(spec)
    unknown = [m for m in chosen if m not in spec]
    if unknown:
        raise ValueError(f"metrics not in the aggregation config: {unknown}")
    return {m: spec[m] for m in chosen}


def metric_expr(name: str, kind: str, src: str | Column | None = None) -> Column:
    c = F.col(name) if src is None else (F.col(src) if isinstance(src, str) else src)
    scale = getattr(kind, "scale", None)
    return (sum_or_zero(c, scale) if kind == "sum" else mean(c, scale)).alias(name)


def agg_exprs(spec: Mapping[str, str]) -> list[Column]:
    return [metric_expr(m, k) for m, k in spec.items()]


def group_agg(df: DataFrame, group_cols: Sequence[str], spec: Mapping[str, str],
              entity_col: str | None = None, count_name: str = "n_entities", more: Sequence[Column] = ()) -> DataFrame:
    """A1 (+A7): ``groupBy(group_cols)`` with the configured sum/mean and,
    optionally, the distinct entity count and ``more`` in the same aggregate.
    NULL group keys are dropped first, as pandas ``groupby`` does (D2)."""
    check_metrics(spec)
    df = df.dropna(subset=list(group_cols))
    exprs = [*agg_exprs(spec), *more]
    if entity_col:
        exprs.append(F.count_distinct(entity_col).alias(count_name))
    return df.groupBy(*group_cols).agg(*exprs)


def to_long(df: DataFrame, ids: Sequence[str], spec: Mapping[str, str],
            metric_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Wide metric columns -> rows ``(ids..., metric, kind, value)``."""
    kinds = F.create_map(*[x for m, k in spec.items() for x in (F.lit(m), F.lit(str(k)))])
    long = df.unpivot(list(ids), [F.col(m).cast("double").alias(m) for m in spec],
                      metric_col, value_col)
    return long.withColumn("kind", kinds[F.col(metric_col)])


def first_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   value_cols: Sequence[str]) -> DataFrame:
    """A4/A5: per key, the first non-null value of each column under an
    explicit ascending ``order`` (pandas ``groupby().first()`` semantics)."""
    ordkey = "struct(" + ", ".join(f"`{o}`" for o in order) + ")"
    exprs = [F.expr(f"min_by(`{c}`, {ordkey}) FILTER (WHERE `{c}` IS NOT NULL)").alias(c)
             for c in value_cols]
    return df.groupBy(*keys).agg(*exprs)


def joined_distinct(c: str | Column, sep: str = "; ") -> Column:
    """Sorted distinct non-null strings joined by ``sep``; none -> ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def distinct_list(df: DataFrame, c: str) -> DataFrame:
    """Sorted distinct non-null values of one column (as a DataFrame)."""
    return df.select(c).dropna().distinct().orderBy(c)


def present_years(df: DataFrame, year_col: str = "year") -> list[int]:
    """The sorted years present, which become pivot columns. More than
    ``spark.sql.pivotMaxValues`` of them are refused, none is left out."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = df.select(F.col(year_col).cast("int").alias("y")).dropna().distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{year_col} has more than {most} values; ask for the years wanted")
    return sorted(r.y for r in rows)


def settle(cells: DataFrame, year_col: str = "year") -> tuple[DataFrame, list[int]]:
    """Aggregated cells, computed once and kept in the checkpoint folder, and the
    years that any of them has (O5): where no year list is exhaustive, change
    runs between the first and the last of these. What the cells come from is
    not read again, and no window or task sees all of them."""
    ensure_checkpoint_dir(cells.sparkSession)
    cells = cells.checkpoint()
    return cells, present_years(cells, year_col)


def first_of_entity(df: DataFrame, group_cols: Sequence[str], entity_col: str, year_col: str = "year",
                    out: str = "_first") -> DataFrame:
    """``df`` with 1 in ``out`` on one row of each entity in its group, else 0.
    Their sums add up to distinct entities over any years (A8): one aggregate by
    group and year then gives the metrics and, summed over a group's few cells,
    the group's entities."""
    w = Window.partitionBy(*group_cols, entity_col).orderBy(year_col)
    first = (F.row_number().over(w) == 1) & F.col(entity_col).isNotNull()
    return df.withColumn(out, first.cast("long"))
