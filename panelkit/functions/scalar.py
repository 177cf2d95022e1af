"""Scalar column expressions (F1-F10). All are Catalyst expressions, so they
stay inside whole-stage codegen; no Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_pct(num: str | Column, den: str | Column) -> Column:
    """num / den * 100 with division by zero (or NULL) giving 0 (F1, F2)."""
    return F.coalesce(F.try_divide(col(num), col(den)) * F.lit(100.0), F.lit(0.0))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, 0 when den is 0 or NULL (F9 sum branch)."""
    return F.coalesce(F.try_divide(col(num), col(den)), F.lit(0.0))


def round_even(c: str | Column, scale: int = 2) -> Column:
    """Rounding as numpy does it (F3): scale up, to the nearest whole number
    (halves to even), scale down. 0.0 is added so that -0.0 becomes 0.0."""
    if scale == 0:
        return F.rint(col(c)) + F.lit(0.0)
    return F.rint(col(c) * F.lit(10.0 ** scale)) / F.lit(10.0 ** scale) + F.lit(0.0)


def round_by_kind(value: str | Column, kind: str | Column) -> Column:
    """Sum metrics to whole numbers, mean metrics to two places."""
    v, k = col(value), col(kind)
    return F.when(k == "sum", round_even(v, 0)).otherwise(round_even(v, 2))


# Fixed value: the characters Python's str.strip() removes (Unicode White_Space
# plus the four ASCII information separators).
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"


def strip_ws(c: str | Column) -> Column:
    """Remove every kind of leading/trailing white space (Python str.strip)."""
    return F.regexp_replace(col(c), f"\\A{WS_CLASS}+|{WS_CLASS}+\\z", "")


def to_number(c: str | Column) -> Column:
    """Numeric coercion: bad text -> NULL, NaN -> NULL."""
    d = col(c).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def exact_sum(c: str | Column, scale: int) -> Column:
    """Sum (as double) that does not depend on the order of rows: values are
    added as decimals of the declared ``scale``. A value that has more places,
    or is too large, fails the job; nothing is rounded."""
    v = col(c).cast("double")
    v = F.when(~F.isnan(v), v)
    d = v.try_cast(f"decimal(28,{scale})")
    bad = F.raise_error(F.concat(F.lit(f"value does not fit {scale} decimal places: "),
                                 v.cast("string"))).cast(f"decimal(28,{scale})")
    return F.sum(F.when(v.isNull() | (d.cast("double") == v), d).otherwise(bad)).cast("double")


#: Units (of a declared scale) that a value counts as few of: longs hold the sum
#: of 2^32 such values.
FEW = 1 << 31


def few_units(df: DataFrame, cols: Sequence[str], scale: int) -> bool:
    """Whether all values of the columns are of few units (one aggregate; NULL is,
    NaN isn't). Then sums of ``units`` stand for ``exact_sum``, many times cheaper."""
    most = df.agg(*[F.max(F.abs(F.col(c).cast("double"))).alias(c) for c in cols]).first()
    return all(m is None or m * 10 ** scale < FEW - 1 for m in most)


def units(c: str | Column, scale: int) -> Column:
    """A value of few units as a long of them; one with more places fails the job."""
    v = col(c).cast("double")
    n = F.rint(v * F.lit(10.0 ** scale))
    bad = F.raise_error(F.concat(F.lit(f"value does not fit {scale} decimal places: "), v.cast("string"))).cast("long")
    # A double that is the nearest one to few units has no more places.
    return F.when(v.isNull() | (n / F.lit(10.0 ** scale) == v), n.cast("long")).otherwise(bad)


def of_units(c: str | Column, scale: int) -> Column:
    """The double nearest to so many units (up to 2^53 of them the quotient is)."""
    far = col(c).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale))
    return F.when(col(c).between(-(1 << 53), 1 << 53), col(c).cast("double") / F.lit(10.0 ** scale)).otherwise(far.cast("double"))


def plain_sum(c: str | Column, scale: int | None = None) -> Column:
    """Sum of the values as they are, or exactly at a declared scale; NaN and
    NULL are skipped; nothing gives NULL."""
    if scale is not None:
        return exact_sum(c, scale)
    v = col(c).cast("double")
    return F.sum(F.when(~F.isnan(v), v))


def sum_or_zero(c: str | Column, scale: int | None = None) -> Column:
    """pandas ``sum``: all-missing gives 0 (A2)."""
    return F.coalesce(plain_sum(c, scale), F.lit(0.0))


def mean(c: str | Column, scale: int | None = None) -> Column:
    """Mean skipping missing values, all-missing -> NULL (A3)."""
    v = col(c).cast("double")
    return F.try_divide(plain_sum(c, scale), F.count(F.when(~F.isnan(v), v)).cast("double"))


def sanitize_name(name: str, limit: int | None = 31) -> str:
    """Name made safe: spaces -> '_', '/' -> '-' (F10). Labels are cut to
    ``limit``; folder names (None) never are."""
    return re.sub(r"\s", "_", str(name)).replace("/", "-")[:limit]
