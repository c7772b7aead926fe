"""Text helpers. White space is Unicode white space throughout."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACES, " "))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring; null text has none."""
    if not words:
        return F.lit(False)
    return F.coalesce(text.rlike("|".join(java_quote(w) for w in words)), F.lit(False))


def matches_any(text: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    flags = "(?i)" if ignore_case else ""
    return F.coalesce(text.rlike(flags + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def java_quote(word: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", word)


def join_nonempty(parts: list[Column], separator: str = " ") -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), separator)


def warnings_to_json(warnings: Column) -> Column:
    """Warnings as JSON without the page where it is unknown; none gives an empty text."""
    return F.when(F.size(warnings) > 0, F.to_json(warnings)).otherwise("")


def warnings_from_json(encoded: Column) -> Column:
    """The warnings of a JSON list; entries that are no objects become code UNKNOWN with the entry as message."""
    entries = F.from_json(encoded, "array<string>")

    def one(entry: Column) -> Column:
        parsed = F.from_json(entry, "code string, message string, page int")
        odd = F.struct(F.lit("UNKNOWN").alias("code"), entry.alias("message"), F.lit(None).cast("int").alias("page"))
        return F.when(entry.startswith("{"), parsed).otherwise(odd)

    none = F.array().cast("array<struct<code:string,message:string,page:int>>")
    return F.coalesce(F.transform(entries, one), none)
