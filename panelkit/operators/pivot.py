"""Pivots and transposes.

Reports stay long ``(index..., year, metric, value)`` until the last step and
pivot once, always with an explicit list of years so Spark needs no extra
job to discover pivot values and the output schema is fixed by the config.
Cells are unique per (index, metric, year), so the pivot aggregate is a plain
``max``. Absent cells are filled with 0 (pandas ``fill_value=0``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_labels(df: DataFrame, index: Sequence[str], label_col: str,
                 labels: Sequence[str], value_col: str = "value",
                 fill: float | None = None) -> DataFrame:
    """Generic explicit-value pivot: one output column per label, in order."""
    wide = (df.filter(F.col(label_col).isin(list(labels)))
              .groupBy(*index).pivot(label_col, list(labels)).agg(F.max(value_col)))
    out = wide.select(*index, *[F.col(f"`{lab}`") for lab in labels])
    if fill is not None:
        out = out.na.fill(fill, list(labels))
    return out
