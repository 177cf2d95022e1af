"""Dates in staged text (F6, F7): an ordered grammar of formats, compiled into one
Catalyst expression that tells the moment, its year and the format met."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"(\d{1,2})"
_TIME = r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)"


@dataclass(frozen=True)
class Format:
    """Text that matches ``pattern`` whole stands for ``moment``, a timestamp made
    of the pattern's groups ($1, $2, ...)."""
    name: str
    pattern: str
    moment: str


#: The formats, in the order in which they are tried. Day and month
#: in the order of the text; a full stop may close the Hungarian form.
FORMATS = (
    Format("iso", rf"(\d{{4}})-{_DAY}-{_DAY}", "$1-$2-$3"),
    Format("iso_time", rf"(\d{{4}})-{_DAY}-{_DAY}[T ]{_TIME}(?:Z|[+-]\d{{2}}:?\d{{2}})?", "$1-$2-$3 $4"),
    Format("dots", rf"(\d{{4}})\.\s?{_DAY}\.\s?{_DAY}\.?", "$1-$2-$3"),
    Format("dots_time", rf"(\d{{4}})\.\s?{_DAY}\.\s?{_DAY}\.?\s{_TIME}", "$1-$2-$3 $4"),
    Format("slashes", rf"(\d{{4}})/{_DAY}/{_DAY}", "$1-$2-$3"),
    Format("month_first", rf"{_DAY}/{_DAY}/(\d{{4}})", "$3-$1-$2"),
)

#: A spreadsheet's day numbers, taken for dates only where asked: day 0 and the
#: first and last day that has four digits in its year.
SERIAL_ZERO, SERIAL_FIRST, SERIAL_LAST = "1899-12-30", 1, 2958465


def _text(c: str | Column) -> Column:
    return F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))


def _pick(t: Column, formats: Sequence[Format], of) -> Column:
    """``of(format, pattern)`` of the first format whose pattern fits."""
    out = F.lit(None).cast("string")
    for f in reversed(formats):
        whole = rf"^{f.pattern}$"
        out = F.when(t.rlike(whole), of(f, whole)).otherwise(out)
    return out


def moment(c: str | Column, formats: Sequence[Format] = FORMATS) -> Column:
    """The timestamp (without zone) that a cell's text stands for; NULL where no
    format fits or the day doesn't exist. The first format whose pattern fits
    decides. A time's zone is dropped: the wall time counts."""
    t = _text(c)
    made = _pick(t, formats, lambda f, whole: F.regexp_replace(t, whole, f.moment))
    return made.try_cast("timestamp_ntz")


def parse_date(c: str | Column, formats: Sequence[Format] = FORMATS, serial: bool = False) -> Column:
    """struct(value, year, format) of a text, number or date cell, all NULL where
    it holds no date. With ``serial`` whole and broken numbers in a spreadsheet's
    range are its day numbers (format "serial", the time of day is dropped)."""
    t, value = _text(c), moment(c, formats)
    name = F.when(value.isNotNull(), _pick(t, formats, lambda f, whole: F.lit(f.name)))
    if serial:
        n = t.try_cast("double")
        fits = n.between(SERIAL_FIRST, SERIAL_LAST)
        day = F.date_add(F.lit(SERIAL_ZERO).cast("date"), F.floor(F.when(fits, n)).cast("int"))
        value, name = F.coalesce(value, day.cast("timestamp_ntz")), F.coalesce(name, F.when(fits, F.lit("serial")))
    return F.struct(value.alias("value"), F.year(value).alias("year"), name.alias("format"))


def is_date(c: str | Column, formats: Sequence[Format] = FORMATS) -> Column:
    """whether a cell holds a date (a number doesn't)."""
    return moment(c, formats).isNotNull()


def integral_year(c: str | Column, formats: Sequence[Format] = FORMATS) -> Column:
    """The year of a cell: a whole number itself, else a date's year."""
    n = _text(c).try_cast("double")
    return F.when(n.isNotNull(), F.when(n == F.floor(n), n.try_cast("int"))).otherwise(F.year(moment(c, formats)))
