"""Reshaping of staged input.

The wide questionnaire row is renamed once, recoded with Catalyst
expressions and split vertically into normalized tables by plain
``select``s over the same scan; nothing here shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import strip_ws
from .quality import YES_NO


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; keys that are not columns are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def split(df: DataFrame, tables: Mapping[str, Sequence[str]],
          keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """One DataFrame per target table (columns absent from the input are
    skipped); ``keep`` columns (ids, stamps) go to every table."""
    out = {}
    for name, cols in tables.items():
        present = [c for c in [*keep, *cols] if c in df.columns]
        out[name] = df.select(*dict.fromkeys(present))
    return out


def recode_yes_no(c: str | Column) -> Column:
    """P3: 'igen' -> '1', 'nem' -> '0', case- and blank-insensitive; other values
    stay as they are (the rules report them, a cast to a number drops them)."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.lower(strip_ws(c))
    yes, no = YES_NO
    return F.when(v == yes, F.lit("1")).when(v == no, F.lit("0")).otherwise(c)


def recode_map(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Map listed values, unmapped -> NULL."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, F.col(c) if isinstance(c, str) else c)


def explode_list(df: DataFrame, c: str, keep: Sequence[str], sep: str = ",",
                 out: str = "item") -> DataFrame:
    """P5: one row per separated part, white space stripped, with its
    position; NULL text gives no row."""
    parts = F.split(F.col(c), sep, -1)
    return (df.select(*keep, F.posexplode(parts).alias("pos", "_raw"))
              .select(*keep, "pos", strip_ws("_raw").alias(out)))


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add each default column only when the input does not have it."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast staged text to its target type; bad values become NULL (the
    rules have reported them already)."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})
