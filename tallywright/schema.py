"""Column semantics, synonyms and the transaction schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Substrings that give a column its meaning, in order of precedence.
PATTERNS = {
    "date": ("date", "time", "when"),
    "description": ("detail", "description", "memo", "reference", "transaction", "desc"),
    "debit": ("debit", "withdrawal", "out", "expense", "charge"),
    "credit": ("credit", "deposit", "in", "income", "payment"),
    "balance": ("balance", "total", "amount", "sum"),
}
# Input names of each field; the first present name wins.
SYNONYMS = {
    "date": ("Date", "date", "Transaction Date"),
    "details": ("Details", "details", "Description", "Narrative"),
    "debit": ("Debit €", "Debit £", "Debit $", "Debit_AMT", "Debit", "Debit Amount", "debit"),
    "credit": ("Credit €", "Credit £", "Credit $", "Credit_AMT", "Credit", "Credit Amount", "credit"),
    "balance": ("Balance €", "Balance £", "Balance $", "Balance_AMT", "Balance", "Running Balance", "balance"),
    "filename": ("Filename", "filename", "source_pdf"),
}
# Default table layout, left and right edge of each column.
DEFAULT_COLUMNS = {
    "Date": (26, 78),
    "Details": (78, 255),
    "Debit": (255, 313),
    "Credit": (313, 369),
    "Balance": (369, 434),
}
OUTPUT_COLUMNS = ("Date", "Details", "Debit", "Credit", "Balance", "Filename")

WARNING = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("page", T.IntegerType())]
)
TRANSACTION = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("row_no", T.IntegerType()),
        *(T.StructField(n, T.StringType()) for n in ("date", "details", "debit", "credit", "balance", "filename")),
        T.StructField("additional_fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("source_page", T.IntegerType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("extraction_warnings", T.ArrayType(WARNING)),
        T.StructField("document_type", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
    ]
)


def column_type(name: str) -> str:
    lowered = name.lower()
    return next((kind for kind, words in PATTERNS.items() if any(w in lowered for w in words)), "other")


def columns_of_type(names, kind: str) -> list[str]:
    return [n for n in names if column_type(n) == kind]


def first_of_type(names, kind: str) -> str | None:
    return next(iter(columns_of_type(names, kind)), None)


def has_types(names, kinds) -> bool:
    return set(kinds) <= {column_type(n) for n in names}


def matching_columns(names, patterns) -> list[str]:
    """Names that contain a pattern, pattern by pattern, each once."""
    return list(dict.fromkeys(n for p in patterns for n in names if p.lower() in n.lower()))


def column_names(columns) -> list[str]:
    return [*columns, *([] if "Filename" in columns else ["Filename"])]


def is_date_column(name: str) -> bool:
    return name.lower() == "date"
