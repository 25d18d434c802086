"""Free-text dates reduced to (year, month, day), and the year readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinforge.functions.literals import lookup
from kinforge.functions.values import MONTHS

# --- fixed values: date formats ---------------------------------------------------------
APPROX_PREFIX = r"(?i)^(abt|about|circa|c\.?|~)\s*"
NUMERIC_DATE = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})$"
TEXT_DATE = r"(?i)^(?:(\d{1,2})\s+)?([a-z]+)\s+(\d{4})$"
BOUNDED_YEAR = r"\b(1[6-9]\d{2}|20[0-2]\d)\b"
CENTURY_SPLIT = 25


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), APPROX_PREFIX, "")


def _month(s: Column) -> Column:
    return lookup(MONTHS, F.lower(F.regexp_extract(s, TEXT_DATE, 2)))


_PREFIX = r"(?i)^\s*(?:(?:abt|about|circa|c\.?|~)\s*)?"
_MONTH_WORDS = "|".join(sorted(MONTHS, key=len, reverse=True))
WHOLE_YEAR = _PREFIX + r"(?:\d{1,2}[./-]\d{1,2}[./-]|(?:\d{1,2}\s+)?(?:" + _MONTH_WORDS + r")\s+)?(\d{4})\s*$"
# A date inside running text: figures, a month with a year, or a year.
DATE_PHRASE = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|(?:\d{1,2}\s+)?\b(?:" + _MONTH_WORDS + r")\s+\d{4}|\d{4}"
SHORT_YEAR = _PREFIX + r"\d{1,2}[./-]\d{1,2}[./-](\d{2})\s*$"


def date_year(c: Column) -> Column:
    """Year of a free-text date, or null when the text is not a date. One pattern, a second
    only for two-digit years."""
    short = _int(F.regexp_extract(c, SHORT_YEAR, 1))
    century = F.when(short > CENTURY_SPLIT, 1900).otherwise(2000)
    return F.coalesce(_int(F.regexp_extract(c, WHOLE_YEAR, 1)), short + century)


def normalize_date(c: Column) -> Column:
    """STRUCT<year, month, day>; null when the text is not a date. No range check."""
    s = _stripped(c)
    numeric = s.rlike(NUMERIC_DATE)
    month = F.when(numeric, _int(F.regexp_extract(s, NUMERIC_DATE, 2))).otherwise(_month(s))
    day = F.when(numeric, _int(F.regexp_extract(s, NUMERIC_DATE, 1))).when(
        _month(s).isNotNull(), _int(F.regexp_extract(s, TEXT_DATE, 1))
    )
    year = date_year(c)
    return F.when(
        year.isNotNull(), F.struct(year.alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"))
    )


def extract_year(c: Column, mode: str) -> Column:
    """``first4``: first four digits. ``bounded``: 1600-2029 as a word, as a number.
    ``word``: any four-digit word as text. ``display``: the same, else the text itself."""
    if mode == "first4":
        return _int(F.regexp_extract(c, r"(\d{4})", 1))
    if mode == "bounded":
        return _int(F.regexp_extract(c, BOUNDED_YEAR, 1))
    found = F.regexp_extract(c, r"\b(\d{4})\b", 1)
    if mode == "word":
        return F.when(found != "", found)
    if mode == "display":
        return F.when(c.isNull(), "").when(found != "", found).otherwise(c)
    raise ValueError(mode)


def api_year(c: Column) -> Column:
    return date_year(c).cast("string")


def year_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)
