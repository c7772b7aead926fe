"""Money: parsing, exact amounts and rendering.

``to_float`` reads parentheses as a minus and strips currency signs, commas
and spaces. ``to_decimal`` is the exact reading that reports use: it knows no
parentheses, and a cell of nothing but signs is zero. Neither accepts NaN,
infinities, underscores or doubled signs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import is_blank, strip

SIGNS = r"(?U)[€$£¥\s,]"
NUMBER = r"^(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DECIMAL = "decimal(38,10)"


def strip_currency(text: Column) -> Column:
    return F.regexp_replace(text, SIGNS, "")


def to_float(text: Column, allow_negative: bool = True) -> Column:
    trimmed = strip(text)
    wrapped = trimmed.rlike(r"^\(.*\)$")
    inner = F.when(wrapped, F.regexp_replace(trimmed, r"^\(|\)$", "")).otherwise(trimmed)
    bare = strip_currency(inner)
    minus = wrapped | bare.startswith("-")
    digits = F.regexp_replace(bare, r"^[+-]", "")
    value = F.when(digits.rlike(NUMBER), digits.try_cast("double"))
    signed = F.when(minus, -value).otherwise(value)
    return signed if allow_negative else F.when(~minus, signed)


def to_decimal(text: Column) -> Column:
    """Exact value of a cell; null where it isn't a number or the cell is null."""
    bare = strip_currency(text)
    bare = F.when(bare == "", "0").otherwise(bare)
    return F.when(F.regexp_replace(bare, r"^[+-]", "").rlike(NUMBER), bare.try_cast(DECIMAL))


def signed_amount(debit: Column, credit: Column) -> Column:
    """Minus the debit where there is one, else the credit."""
    return F.when(~is_blank(debit), -to_decimal(debit)).when(~is_blank(credit), to_decimal(credit))


def absolute_amount(debit: Column, credit: Column) -> Column:
    return F.abs(signed_amount(debit, credit))


def format_currency(amount: Column, symbol: str = "€", places: int = 2) -> Column:
    """``-€1,234.50``; null gives an empty text."""
    shown = F.concat(
        F.when(amount < 0, "-").otherwise(""), F.lit(symbol), F.format_number(F.abs(amount), places)
    )
    return F.coalesce(shown, F.lit(""))


def money_text(amount: Column) -> Column:
    """Two places, ties to even, without grouping."""
    return F.bround(amount.cast(DECIMAL), 2).cast("decimal(38,2)").cast("string")


def reroute_credit(debit: Column, credit: Column) -> tuple[Column, Column]:
    """A debit that ends in CR is a credit: (debit, credit)."""
    is_credit = F.coalesce(F.upper(strip(debit)).endswith("CR"), F.lit(False))
    moved = strip(F.regexp_replace(strip(debit), r"(?i)CR$", ""))
    return F.when(is_credit, "").otherwise(debit), F.when(is_credit, moved).otherwise(credit)
