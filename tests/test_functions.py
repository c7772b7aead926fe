"""Value matrices of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.functions import amounts, bbox, dates, iban


def one(spark, column, **cells):
    kinds = {str: "string", float: "double", int: "int", type(None): "string"}
    schema_ = ", ".join(f"{k} {kinds[type(v)]}" for k, v in cells.items()) or "x int"
    return spark.createDataFrame([tuple(cells.values()) or (1,)], schema_).select(column).first()[0]


@pytest.mark.parametrize(
    "text, value",
    [
        ("123.45", 123.45),
        ("€10,000.99", 10000.99),
        ("¥123", 123.0),
        ("  €123.45  ", 123.45),
        ("(123.45)", -123.45),
        ("-€123.45", -123.45),
        ("€-123.45", -123.45),
        ("(€123.45)", -123.45),
        ("+123.45", 123.45),
        ("€+123.45", 123.45),
        ("(-5)", -5.0),
        (" 12.50", 12.5),
        ("", None),
        ("   ", None),
        (None, None),
        ("€", None),
        ("abc", None),
        ("€€€", None),
        ("1.5d", None),
        ("NaN", None),
        ("--5", None),
    ],
)
def test_to_float(spark, text, value):
    assert one(spark, amounts.to_float(F.col("t")), t=text) == value


def test_negatives_can_be_refused(spark):
    for text in ("(123.45)", "-€1", "€-1"):
        assert one(spark, amounts.to_float(F.col("t"), allow_negative=False), t=text) is None


def test_exact_amounts_know_no_parentheses(spark):
    assert one(spark, amounts.to_decimal(F.col("t")), t="(5)") is None
    assert one(spark, amounts.to_decimal(F.col("t")), t="€") == 0


@pytest.mark.parametrize(
    "value, symbol, places, shown",
    [(1234.5, "€", 2, "€1,234.50"), (-50.0, "€", 2, "-€50.00"), (100.123, "€", 3, "€100.123"), (100.0, "€", 0, "€100"), (1000000.0, "€", 2, "€1,000,000.00")],
)
def test_format_currency(spark, value, symbol, places, shown):
    assert one(spark, amounts.format_currency(F.col("v"), symbol, places), v=value) == shown


@pytest.mark.parametrize(
    "text, hint, day",
    [
        ("3 Feb", 2026, dt.date(2026, 2, 3)),
        ("3 February", 2026, dt.date(2026, 2, 3)),
        ("3 Feb", None, dt.date(1970, 1, 1)),
        ("1 Dec", 2024, dt.date(2024, 12, 1)),
        ("29 Feb", 2024, dt.date(1970, 1, 1)),
        ("01/12/2023", None, dt.date(2023, 12, 1)),
        ("01/12/23", None, dt.date(2023, 12, 1)),
        ("01/12/73", None, dt.date(1973, 12, 1)),
        ("1  Feb 2025", None, dt.date(2025, 2, 1)),
        ("01 FEB 2025", None, dt.date(2025, 2, 1)),
        ("01FEB25", None, dt.date(2025, 2, 1)),
        ("5 Sept 2024", None, dt.date(2024, 9, 5)),
        ("5 September 2024", None, dt.date(2024, 9, 5)),
        ("31/02/2023", None, dt.date(1970, 1, 1)),
        ("2024-01-05", None, dt.date(1970, 1, 1)),
        ("5/6", None, dt.date(2023, 6, 5)),
        ("", None, dt.date(1970, 1, 1)),
        (None, None, dt.date(1970, 1, 1)),
    ],
)
def test_parse_date(spark, text, hint, day):
    year = F.lit(hint).cast("int")
    assert one(spark, dates.parse_date(F.col("t"), year), t=text) == day


def test_september_as_it_was(spark):
    assert one(spark, dates.parse_date(F.col("t"), compat_september=True), t="5 September 2024") == dt.date(1970, 1, 1)


@pytest.mark.parametrize(
    "text, found",
    [
        ("IE29AIBK93115212345678", "IE29AIBK93115212345678"),
        ("IE29 AIBK 9311 5212 3456 78", "IE29AIBK93115212345678"),
        ("IE29-AIBK-9311-5212-3456-78", "IE29AIBK93115212345678"),
        ("no number", None),
        ("XX12345678901234", None),
    ],
)
def test_find_iban(spark, text, found):
    assert one(spark, iban.find_iban(F.col("t")), t=text) == found


def test_iban_parts(spark):
    assert one(spark, iban.passes_mod97(F.col("t")), t="GB29NWBK60161331926819") is True
    assert one(spark, iban.passes_mod97(F.col("t")), t="GB28NWBK60161331926819") is False
    assert one(spark, iban.mask_iban(F.col("t")), t="IE29AIBK93115212345678") == "IE29" + "*" * 14 + "5678"
    assert one(spark, iban.account_suffix(F.col("t")), t="ie29 aibk 9abc") == "9ABC"
    assert one(spark, iban.card_suffix(F.col("t")), t="**** ****") == "unknown"


def test_boxes(spark):
    a = bbox.box(*(F.lit(float(v)) for v in (0, 0, 10, 10)))
    b = bbox.box(*(F.lit(float(v)) for v in (10, 10, 20, 20)))
    c = bbox.box(*(F.lit(float(v)) for v in (5, 5, 10, 10)))
    assert one(spark, bbox.overlaps(a, b)) is True
    assert one(spark, bbox.overlap_ratio(a, c)) == 1.0
    assert one(spark, bbox.overlap_ratio(a, b)) == 0.0


def test_column_types():
    kinds = {"Money out": "debit", "Money in": "credit", "Amount": "balance", "Transaction Date": "date", "Routing": "debit", "Xyz": "other"}
    assert {n: schema.column_type(n) for n in kinds} == kinds
    assert schema.matching_columns(["Debit €", "Credit €", "Total debit"], ["debit"]) == ["Debit €", "Total debit"]
