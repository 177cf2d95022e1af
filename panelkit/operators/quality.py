"""Declarative data-quality rules.

A rule is a column predicate that is TRUE when a value violates it; NULL
values pass every rule, and a rule whose column is absent is skipped. All
rules of a sheet are evaluated in ONE pass: each row builds an array of
``struct(column, rule, value)`` for the rules it breaks, the array is
filtered and exploded into a ``violations`` DataFrame. No Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import FORMATS, Format, integral_year, is_date
from ..functions.scalar import strip_ws

# The yes/no words accepted by the questionnaire (case-insensitive).
YES_NO = ("igen", "nem")
# E-mail and phone patterns of the questionnaire rules; (?U) makes
# Java's \w and \d Unicode-aware like Python's.
EMAIL_PATTERN = r"(?U)^[\w\.-]+@[\w\.-]+\.\w+$"
PHONE_PATTERN = r"(?U)^\+?[\d\s\-\(\)/]+$"
# The twenty counties, seven regions, provider kinds and
# infrastructure conditions accepted by the questionnaire.
COUNTIES = ("Bács-Kiskun", "Baranya", "Békés", "Borsod-Abaúj-Zemplén", "Csongrád-Csanád",
            "Fejér", "Győr-Moson-Sopron", "Hajdú-Bihar", "Heves", "Jász-Nagykun-Szolnok",
            "Komárom-Esztergom", "Nógrád", "Pest", "Somogy", "Szabolcs-Szatmár-Bereg", "Tolna",
            "Vas", "Veszprém", "Zala", "Budapest")
REGIONS = ("Közép-Magyarország", "Közép-Dunántúl", "Nyugat-Dunántúl", "Dél-Dunántúl",
           "Észak-Magyarország", "Észak-Alföld", "Dél-Alföld")
PROVIDER_KINDS = ("A park üzemeltetője", "Betelepült vállalkozás", "Egyéb")
CONDITIONS = ("Megfelelő", "Bővítendő", "Felújítandó")

TOL = 1e-6


def _num(c: Column) -> Column:
    d = c.cast("string").try_cast("double")
    return F.when(~F.isnan(d), d)


@dataclass(frozen=True)
class Rule:
    """``violated(col) -> Column`` is TRUE for a violation; NULL passes."""
    name: str
    columns: tuple[str, ...]
    violated: Callable[..., Column]
    multi: bool = False          # one predicate over all columns together
    label: str | None = None     # column label for multi-column rules

    def exprs(self, present: set[str]) -> list[Column]:
        out = []
        if self.multi:
            if not set(self.columns) <= present:
                return out
            pred = self.violated(*[F.col(c) for c in self.columns])
            value = F.concat_ws(";", *[F.col(c).cast("string") for c in self.columns])
            out.append(F.when(F.coalesce(pred, F.lit(False)),
                              F.struct(F.lit(self.label or "+".join(self.columns)).alias("field"),
                                       F.lit(self.name).alias("rule"), value.alias("value"))))
            return out
        for c in self.columns:
            if c not in present:
                continue
            col = F.col(c)
            pred = col.isNotNull() & self.violated(col)
            out.append(F.when(F.coalesce(pred, F.lit(False)),
                              F.struct(F.lit(c).alias("field"), F.lit(self.name).alias("rule"),
                                       col.cast("string").alias("value"))))
        return out


# ----------------------------------------------------------- rule builders
def max_length(cols: Sequence[str], n: int) -> Rule:                       # C1, C2
    return Rule(f"max_length_{n}", tuple(cols), lambda c: F.length(c) > n)


def not_date(cols: Sequence[str], formats: Sequence[Format] = FORMATS) -> Rule:  # C3
    return Rule("not_date", tuple(cols), lambda c: ~is_date(c, formats))


def year_range(cols: Sequence[str], lo: int, hi: int) -> Rule:            # C4
    """A whole number, or the year of a date cell, outside lo..hi."""
    def v(c):
        y = integral_year(c)
        return y.isNull() | (y < lo) | (y > hi)
    return Rule("year_range", tuple(cols), v)


def year_not_before(cols: Sequence[str], as_of_year: int) -> Rule:         # C5
    def v(c):
        y = integral_year(c)
        return y.isNull() | (y < as_of_year)
    return Rule("year_not_before", tuple(cols), v)


def pattern(cols: Sequence[str], regex: str, name: str) -> Rule:          # C6, C15
    return Rule(name, tuple(cols), lambda c: ~c.cast("string").rlike(regex))


def percent(cols: Sequence[str]) -> Rule:                                 # C7
    def v(c):
        d = _num(c)
        return d.isNull() | (d < 0) | (d > 100)
    return Rule("percent", tuple(cols), v)


def nonneg_real(cols: Sequence[str]) -> Rule:                             # C8
    def v(c):
        d = _num(c)
        return d.isNull() | (d < 0)
    return Rule("nonneg_real", tuple(cols), v)


def nonneg_int(cols: Sequence[str]) -> Rule:                              # C9
    def v(c):
        d = _num(c)
        return d.isNull() | (d < 0) | (d != F.floor(d))
    return Rule("nonneg_int", tuple(cols), v)


def yes_no(cols: Sequence[str]) -> Rule:                                  # C10
    return Rule("yes_no", tuple(cols), lambda c: ~F.lower(c.cast("string")).isin(*YES_NO))


def one_of(cols: Sequence[str], values: Sequence[str], normalize: bool = False,
           name: str = "one_of") -> Rule:                                  # C11-C14
    if normalize:
        vals = [v.strip().lower() for v in values]
        return Rule(name, tuple(cols), lambda c: ~F.lower(strip_ws(c)).isin(*vals))
    return Rule(name, tuple(cols), lambda c: ~c.isin(*list(values)))


def county(cols: Sequence[str]) -> Rule:                                  # C11
    return one_of(cols, COUNTIES, name="county")


def region(cols: Sequence[str]) -> Rule:                                  # C12
    return one_of(cols, REGIONS, name="region")


def provider_kind(cols: Sequence[str]) -> Rule:                           # C13
    return one_of(cols, PROVIDER_KINDS, normalize=True, name="provider_kind")


def condition(cols: Sequence[str]) -> Rule:                               # C14
    return one_of(cols, CONDITIONS, normalize=True, name="condition")


def sum_equals(cols: Sequence[str], total: float | str, name: str = "sum_equals",
               tol: float = TOL) -> Rule:                                  # C16, C20
    """Only when every part (and the total) is present, as NULL propagates."""
    allc = list(cols) + ([total] if isinstance(total, str) else [])

    def v(*cs):
        parts = [_num(c) for c in cs[:len(cols)]]
        tot = _num(cs[-1]) if isinstance(total, str) else F.lit(float(total))
        s = parts[0]
        for p in parts[1:]:
            s = s + p
        return F.abs(s - tot) > tol
    return Rule(name, tuple(allc), v, multi=True)


def sum_at_most(cols: Sequence[str], limit: float | str, name: str = "sum_at_most",
                tol: float = TOL) -> Rule:                                 # C18, C19, C21
    allc = list(cols) + ([limit] if isinstance(limit, str) else [])

    def v(*cs):
        parts = [_num(c) for c in cs[:len(cols)]]
        lim = _num(cs[-1]) if isinstance(limit, str) else F.lit(float(limit))
        s = parts[0]
        for p in parts[1:]:
            s = s + p
        return s > lim + tol
    return Rule(name, tuple(allc), v, multi=True)


def at_most(a: str, b: str, name: str = "at_most") -> Rule:               # C17
    return Rule(name, (a, b), lambda x, y: _num(x) > _num(y), multi=True)


# --------------------------------------------------------------- evaluation
def violations(df: DataFrame, rules: Sequence[Rule], id_cols: Sequence[str],
               sheet: str) -> DataFrame:
    """One pass over ``df``: rows ``(sheet, id_cols..., field, rule, value)``."""
    present = set(df.columns)
    exprs = [e for r in rules for e in r.exprs(present)]
    if not exprs:
        return df.select(F.lit(sheet).alias("sheet"), *id_cols,
                         F.lit(None).cast("string").alias("field"),
                         F.lit(None).cast("string").alias("rule"),
                         F.lit(None).cast("string").alias("value")).limit(0)
    # Every predicate once; explode and a plain null filter stay inside
    # whole-stage codegen (a higher-order ``filter`` would not).
    return (df.select(*id_cols, F.explode(F.array(*exprs)).alias("v"))
              .filter(F.col("v").isNotNull())
              .select(F.lit(sheet).alias("sheet"), *id_cols, "v.field", "v.rule", "v.value"))


def gate(df: DataFrame, bad: DataFrame, key: Sequence[str]) -> DataFrame:
    """C22 at scale: drop every submission (``key``) with any violation; the
    rest goes on. The violation side is reduced to distinct keys first."""
    return df.join(bad.select(*key).distinct(), list(key), "left_anti")


def audit_pk(df: DataFrame, key: Sequence[str]) -> DataFrame:              # C23, C25
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def audit_fk(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str,
             name: str) -> DataFrame:                                       # C24
    """Orphan keys and how many child rows hold each."""
    c = child.select(F.col(child_key).alias("key")).filter(F.col("key").isNotNull())
    c = c.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    p = parent.select(F.col(parent_key).alias("key"))
    return c.join(p, "key", "left_anti").select(F.lit(name).alias("fk"), "key", "n_rows")


def audit_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:        # C26
    """One aggregate pass: NULL count per column, only columns with NULLs."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = agg.unpivot([], list(cols), "field", "n_null")
    return long.filter(F.col("n_null") > 0)


def check_whitelist(df: DataFrame, table: str, allowed: dict[str, Sequence[str]]) -> None:  # C27
    if table not in allowed:
        raise ValueError(f"table {table!r} is not writable")
    extra = [c for c in df.columns if c not in allowed[table]]
    if extra:
        raise ValueError(f"columns not allowed in {table!r}: {extra}")
