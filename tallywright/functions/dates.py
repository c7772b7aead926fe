"""Dates as statements print them.

Two-digit years below 50 belong to 2000, others to 1900; a day and month
without a year take the hint; what cannot be read is the epoch, so that it
sorts first. ISO dates are not statement dates. The accepted formats differ in
separators and in how month and year are written, so one expression takes day,
month and year apart and nothing is parsed by trial.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import collapse

EPOCH = "1970-01-01"
DEFAULT_YEAR = 2023
# Accepted formats: d/m/y and d-m-y, day, month name and year with a space between each or none.
WITH_YEAR = r"^(\d{1,2})(?:/(\d{1,2})/|-(\d{1,2})-| ([A-Za-z]+) |([A-Za-z]+))(\d{4}|\d{2})$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_YEARLESS = r"^\d{1,2}\s+[A-Za-z]{3,}$"
_DAY_MONTH = r"^(\d{1,2})\s+([A-Za-z]{3,})$"


def month_number(name: Column) -> Column:
    """1 to 12 of a month's name or its first three letters, in any case, else null."""
    low = F.lower(name)
    at = F.instr(F.lit("".join(m[:3] for m in MONTHS)), F.substring(low, 1, 3)) - 1
    number = F.when((at >= 0) & (at % 3 == 0), (at / 3).cast("int") + 1)
    return F.when((F.length(low) == 3) | (low == F.elt(number, *[F.lit(m) for m in MONTHS])), number)


def day_of(year: Column, month: Column, day: Column) -> Column:
    """DATE, or null where there is no such day."""
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 29).otherwise(28)
    return F.when(year.between(1, 9999) & month.between(1, 12) & day.between(1, last), F.make_date(year, month, day))


def parse_date(text: Column, hint_year: Column | None = None, compat_september: bool = False) -> Column:
    """DATE, or the epoch. ``compat_september`` also shortens Sept within September, which then fails."""
    clean = collapse(text)
    clean = F.regexp_replace(clean, "Sept", "Sep") if compat_september else F.regexp_replace(clean, r"\bSept\b", "Sep")
    part = lambda k: F.regexp_extract(clean, WITH_YEAR, k)
    number = F.coalesce(part(2).try_cast("int"), part(3).try_cast("int"), month_number(part(4)), month_number(part(5)))
    raw = part(6).try_cast("int")
    year = F.when(F.length(part(6)) == 4, raw).when(raw < 50, raw + 2000).otherwise(raw + 1900)
    tried = [day_of(year, number, part(1).try_cast("int"))]
    if hint_year is not None:
        hinted, day = hint_year.try_cast("int"), F.regexp_extract(clean, _DAY_MONTH, 1).try_cast("int")
        month = month_number(F.regexp_extract(clean, _DAY_MONTH, 2))
        # a day and month are read as of a year that is no leap year
        tried.append(F.when((month != 2) | (day < 29), day_of(hinted, month, day)))
    tried.append(parse_partial(clean))
    return F.coalesce(*tried, F.lit(EPOCH).cast("date"))


def parse_partial(text: Column) -> Column:
    """Day and month, and a year if it is there, parted by / or -."""
    parts = F.split(F.regexp_replace(text, "-", "/"), "/")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("int")
    raw = number(2)
    year = (
        F.when(F.size(parts) < 3, DEFAULT_YEAR)
        .when(raw < 50, raw + 2000)
        .when(raw < 100, raw + 1900)
        .otherwise(raw)
    )
    shaped = text.rlike(r"^\d+[/-]\d+([/-]\d+)?$")
    return F.when(shaped, day_of(year, number(1), number(0)))


def add_year(text: Column, year: Column) -> Column:
    """Appends the statement's year to a date without one."""
    lacks = F.coalesce(text.rlike(_YEARLESS), F.lit(False)) & year.isNotNull() & (year != "")
    return F.when(lacks, F.concat(text, F.lit(" "), year)).otherwise(text)


def month_key(date: Column) -> Column:
    return F.when(F.year(date) <= 1970, "Unknown").otherwise(F.date_format(date, "yyyy-MM"))


def filename_date(name: Column) -> Column:
    """First eight digits of a file name as ``dd Mon YYYY``, else an empty text."""
    found = F.try_to_timestamp(F.regexp_extract(name, r"(\d{8})", 1), F.lit("yyyyMMdd"))
    return F.coalesce(F.date_format(found, "dd MMM yyyy"), F.lit(""))
