"""Year-on-year and first-to-last change.

With an explicit, short list of years the change columns are plain column
arithmetic on the pivoted row: no window, no second shuffle. ``yoy_long``
gives the same numbers in long form with ``lag`` for callers that keep the
long shape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_pct


def add_yoy(df: DataFrame, cols_by_year: Sequence[tuple[int, str]],
            diff_name=lambda y: f"diff_{y}", pct_name=lambda y: f"pct_{y}") -> DataFrame:
    """W2 + W3: for consecutive years ``v_y - v_prev`` and its percent of
    ``v_prev`` (0 when the base is 0)."""
    cols = sorted(cols_by_year)
    new = {}
    for (py, pc), (y, c) in zip(cols, cols[1:]):
        d = F.col(c) - F.col(pc)
        new[diff_name(y)] = d
        new[pct_name(y)] = safe_pct(d, F.col(pc))
    return df.withColumns(new) if new else df


def add_first_last(df: DataFrame, first: str | Column, last: str | Column,
                   diff_name: str = "total_diff", pct_name: str = "total_pct") -> DataFrame:
    """Last - first and its percent of first (0 when first is 0)."""
    f = F.col(first) if isinstance(first, str) else first
    l_ = F.col(last) if isinstance(last, str) else last
    return df.withColumns({diff_name: l_ - f, pct_name: safe_pct(l_ - f, f)})


def add_present_change(df: DataFrame, by_year: Sequence[tuple[int, str]], present: Sequence[int],
                       diff_name: str, pct_name: str) -> DataFrame:
    """W4 between the first and the last of the years ``present`` (O5); NULL
    where only one year is."""
    cols = [c for y, c in sorted(by_year) if y in set(present)]
    if len(cols) < 2:
        return df.withColumns({n: F.lit(None).cast("double") for n in (diff_name, pct_name)})
    return add_first_last(df, cols[0], cols[-1], diff_name, pct_name)


def yoy_long(long: DataFrame, part: Sequence[str], year_col: str = "year",
             value_col: str = "value") -> DataFrame:
    """Long-form W2/W3: ``diff`` and ``pct`` against the previous year of the
    same ``part`` (the frame must already hold the dense year grid)."""
    w = Window.partitionBy(*part).orderBy(year_col)
    prev = F.lag(value_col).over(w)
    return (long.withColumn("_prev", prev)
                .withColumn("diff", F.col(value_col) - F.col("_prev"))
                .withColumn("pct", F.when(F.col("_prev").isNotNull(),
                                          safe_pct(F.col("diff"), F.col("_prev"))))
                .drop("_prev"))


def pair_diff(df: DataFrame, year_col: str, y1: int, y2: int, value_cols: Sequence[str],
              label_col: str = "label", label: str = "difference") -> DataFrame:
    """W6 + U2: append one row ``row(y2) - row(y1)`` to a per-year summary
    (conditional aggregate, no window over the whole frame)."""
    two = df.filter(F.col(year_col).isin([y1, y2]))
    diff = two.agg(*[(F.max(F.when(F.col(year_col) == y2, F.col(c)))
                      - F.max(F.when(F.col(year_col) == y1, F.col(c)))).alias(c)
                     for c in value_cols])
    rows = two.select(F.col(year_col).cast("string").alias(label_col), *value_cols)
    return rows.unionByName(diff.select(F.lit(label).alias(label_col), *value_cols))
