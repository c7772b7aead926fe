"""Operators over transactions: filters, projections, types, accounts, duplicates, order.

Frames have date, details, debit, credit, balance and filename as text, and
order columns that end in a unique one; order is never implied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.functions import amounts, dates, iban, text

# Words that rule a date cell out, and signs of a date.
NOT_DATES = ["product", "account", "total", "balance", "transaction", "statement", "details", "debit", "credit", "description"]
DATE_SIGNS = ["/", "-", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LONGEST_DATE = 25


def has_details(df_details: Column) -> Column:
    return ~text.is_blank(df_details)


def is_empty_row(date="date", details="details", debit="debit", credit="credit", balance="balance") -> Column:
    blank = lambda c: text.is_blank(F.col(c))
    none = blank(details) & blank(debit) & blank(credit)
    return none & (blank(date) | ~blank(balance))


def filter_empty(df: DataFrame) -> DataFrame:
    """Rows without content, and balances without details or amounts even if dated, go."""
    return df.where(~is_empty_row())


def is_header_row(names: Sequence[str] = schema.OUTPUT_COLUMNS) -> Column:
    """At least two cells, and half of those filled, repeat a column name or are part of one."""
    cells = F.filter(F.array(*[F.lower(text.strip(F.coalesce(F.col(c), F.lit("")))) for c in ("date", "details", "debit", "credit", "balance")]), lambda c: c != "")
    known = F.array(*[F.lit(n.lower()) for n in names])
    hits = F.filter(cells, lambda c: F.exists(known, lambda n: F.contains(c, n) | F.contains(n, c)))
    return (F.size(cells) >= 2) & (F.size(hits) * 2 >= F.size(cells))


def filter_header(df: DataFrame, names: Sequence[str] = schema.OUTPUT_COLUMNS) -> DataFrame:
    return df.where(~is_header_row(names))


def looks_dated(date: Column) -> Column:
    low = F.lower(date)
    digits = F.regexp_replace(date, " ", "").rlike(r"^\d+$")
    fits = ~text.is_blank(date) & ~text.contains_any(low, NOT_DATES) & (F.length(date) <= LONGEST_DATE)
    return F.coalesce(fits & (text.contains_any(low, DATE_SIGNS) | digits), F.lit(False))


def filter_dates(df: DataFrame) -> DataFrame:
    return df.where(looks_dated(F.col("date")))


def filter_all(df: DataFrame, names: Sequence[str] = schema.OUTPUT_COLUMNS) -> DataFrame:
    return filter_dates(filter_header(filter_empty(df), names))


def canonical(df: DataFrame) -> DataFrame:
    """Input columns under their synonyms become the canonical ones; the rest goes to a map of text."""
    used, chosen = set(), []
    for field, names in schema.SYNONYMS.items():
        present = next((n for n in names if n in df.columns), None)
        used.update(n for n in names if n in df.columns)
        chosen.append((F.col(f"`{present}`").cast("string") if present else F.lit(None).cast("string")).alias(field))
    rest = [c for c in df.columns if c not in used]
    pairs = [x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    extra = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(*chosen, extra.alias("additional_fields"))


def enrich(df: DataFrame) -> DataFrame:
    """File name from source_pdf where it lacks, and the default document type."""
    source = F.col("source_pdf") if "source_pdf" in df.columns else F.lit(None)
    kind = F.col("document_type") if "document_type" in df.columns else F.lit(None)
    blank_to_null = lambda c: F.when(c != "", c)
    return df.withColumns(
        {
            "filename": F.coalesce(blank_to_null(F.col("filename")), source),
            "document_type": F.coalesce(blank_to_null(kind), F.lit("bank_statement")),
        }
    )


def output_rows(df: DataFrame, suffix: str = "") -> DataFrame:
    """Rows as they are written: a year on yearless dates, names with the currency suffix, warnings as JSON."""
    name = lambda n: f"{n} {suffix}" if suffix else n
    columns = [
        dates.add_year(F.col("date"), F.col("statement_year")).alias("Date"),
        F.col("details").alias("Details"),
        *[F.col(c.lower()).alias(name(c)) for c in ("Debit", "Credit", "Balance")],
        F.col("filename").alias("Filename"),
    ]
    for c in ("source_page", "confidence_score", "document_type", "transaction_type"):
        if c in df.columns:
            columns.append(F.col(c))
    if "extraction_warnings" in df.columns:
        shown = F.filter("extraction_warnings", lambda w: w["code"] != "DATE_PROPAGATED")
        columns.append(F.to_json(shown).alias("extraction_warnings"))
    return df.select(*columns)


# --- transaction types -----------------------------------------------------------------

# Keyword lists, in the order of trial. A keyword is a raw substring of the upper-cased details.
CARD_WORDS = {
    "purchase": ["PURCHASE", "SALE", "POS", "CONTACTLESS", "ONLINE", "RECURRING PAYMENT", "SUBSCRIPTION", "E-COMMERCE"],
    "payment": ["PAYMENT", "PAYMENT RECEIVED", "DIRECT DEBIT", "PAYMENT THANK YOU", "AUTOPAY"],
    "fee": ["FEE", "CHARGE", "INTEREST", "ANNUAL FEE", "LATE FEE", "FOREIGN TRANSACTION FEE", "CASH ADVANCE FEE", "OVERLIMIT FEE"],
    "refund": ["REFUND", "REVERSAL", "CREDIT", "CHARGEBACK"],
}
BANK_WORDS = {
    "transfer": ["TRANSFER", "TRF", "SEPA", "SEPA CREDIT", "SEPA DEBIT", "WIRE", "ONLINE TRANSFER", "MOBILE TRANSFER"],
    "payment": ["STANDING ORDER", "DIRECT DEBIT", "DD", "SO", "BILL PAYMENT"],
    "interest": ["INTEREST", "INT CREDIT", "INTEREST CREDIT", "INTEREST PAID"],
    "fee": ["CHARGE", "FEE", "MAINTENANCE FEE", "TRANSACTION FEE", "ATM FEE", "OVERDRAFT FEE"],
}
CARD, BANK = "credit_card_statement", "bank_statement"


def type_by_words(details: Column, words: dict[str, list[str]]) -> Column:
    """The first type one of whose words occurs, else null."""
    upper = F.upper(F.coalesce(details, F.lit("")))
    return F.coalesce(*[F.when(text.contains_any(upper, [w.upper() for w in ws]), kind) for kind, ws in words.items()], F.lit(None))


def type_by_amount(debit: Column, credit: Column, document_type: Column) -> Column:
    d, c = (F.coalesce(amounts.to_float(x), F.lit(0.0)) for x in (debit, credit))
    card = document_type == CARD
    return (
        F.when((c > 0) & (d == 0), F.when(card, "refund").otherwise("transfer"))
        .when((d > 0) & (c == 0), F.when(card, "purchase").otherwise("payment"))
        .when((d == 0) & (c == 0), "fee")
    )


def classify_types(df: DataFrame, account: str | None = None, order: Sequence[str] = ("ord",), template_words: dict | None = None) -> DataFrame:
    """transaction_type of every row; the chain is that of the account's first row, and each step looks at its own row's type too."""
    kind = lead = F.col("document_type")
    if account:
        # the first row's type of each account: an aggregate that combines before the shuffle, not a sort of the account
        firsts = df.groupBy(F.col(account).alias("_account")).agg(F.min_by(F.struct("document_type"), F.struct(*order))["document_type"].alias("_lead"))
        df, lead = df.join(firsts, F.col(account) == F.col("_account")), F.col("_lead")
    steps = []
    if template_words:
        steps.append(type_by_words(F.col("details"), template_words))
    steps.append(F.when((lead == CARD) & (kind == CARD), type_by_words(F.col("details"), CARD_WORDS)))
    steps.append(F.when((lead == BANK) & (kind == BANK), type_by_words(F.col("details"), BANK_WORDS)))
    steps.append(type_by_amount(F.col("debit"), F.col("credit"), kind))
    return df.withColumn("transaction_type", F.coalesce(*steps, F.lit("other"))).drop("_account", "_lead")


# --- accounts --------------------------------------------------------------------------


def by_account(df: DataFrame, files: DataFrame, column: str, suffix: Callable[[Column], Column]) -> DataFrame:
    """Adds account_suffix from the file's account number; rows without one belong to ``unknown``."""
    known = files.where(F.col(column).isNotNull()).select(F.col("filename").alias("_file"), suffix(F.col(column)).alias("_suffix"))
    return df.join(known, df["filename"] == known["_file"], "left").withColumn("account_suffix", F.coalesce("_suffix", F.lit("unknown"))).drop("_file", "_suffix")


def by_iban(df: DataFrame, files: DataFrame) -> DataFrame:
    return by_account(df, files, "iban", iban.account_suffix)


def by_card(df: DataFrame, files: DataFrame) -> DataFrame:
    return by_account(df, files, "card", iban.card_suffix)


def split_statements(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bank files, card files)."""
    return files.where("card is null"), files.where("card is not null")


def split_unknown(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to process, rows of files without an account): nameless rows stay."""
    unknown = (F.col("account_suffix") == "unknown") & ~text.is_blank(F.col("filename"))
    return df.where(~unknown), df.where(unknown)


# --- duplicates ------------------------------------------------------------------------


def _shown(value: Column) -> Column:
    return F.coalesce(amounts.money_text(value), F.lit(""))


def key_all_fields(extra: Sequence[str] = ()) -> Column:
    """Date, details and every numeric field, additional ones too."""
    cells = [
        F.when(amounts.to_float(F.col(c)).isNotNull(), F.concat(F.lit(f"{c}:"), amounts.to_float(F.col(c)).cast("string")))
        for c in ("debit", "credit", "balance", *extra)
    ]
    return F.concat_ws(":", F.coalesce("date", F.lit("")), F.coalesce("details", F.lit("")), F.array_join(F.array_sort(F.array_compact(F.array(*cells))), ","))


def key_date_amount(extra: Sequence[str] = ()) -> Column:
    """Date and the sum of absolute numbers."""
    total = sum((F.abs(F.coalesce(amounts.to_float(F.col(c)), F.lit(0.0))) for c in ("debit", "credit", "balance", *extra)), F.lit(0.0))
    return F.concat_ws(":", F.coalesce("date", F.lit("")), _shown(total))


def key_card() -> Column:
    """Date, type and the debit or else the credit."""
    value = F.coalesce(amounts.to_float(F.col("debit")), amounts.to_float(F.col("credit")), F.lit(0.0))
    return F.concat_ws(":", F.coalesce("date", F.lit("")), F.coalesce("transaction_type", F.lit("")), _shown(value))


def mark_duplicates(df: DataFrame, key: Column, account: str | None = None, order: str = "ord") -> DataFrame:
    """Adds is_duplicate: the first row of a key names its owner file, and rows of other files repeat it.

    The owner is an aggregate that combines before the shuffle; it meets the
    rows in a join that adaptive execution can split at a hot key.
    """
    group = ["_key", *([account] if account else [])]
    keyed = df.withColumn("_key", key)
    owners = keyed.groupBy(*group).agg(F.min_by(F.struct(F.coalesce("filename", F.lit("")).alias("f")), order).alias("_owner"))
    met = keyed.join(owners, group)
    return met.withColumn("is_duplicate", F.coalesce("filename", F.lit("")) != F.col("_owner.f")).drop("_key", "_owner")


def duplicate_statistics(marked: DataFrame) -> DataFrame:
    total, twice = F.count("*"), F.count(F.when(F.col("is_duplicate"), 1))
    rate = F.when(total > 0, F.round(twice * 100.0 / total, 2)).otherwise(0.0)
    return marked.agg(total.alias("total"), (total - twice).alias("unique_rows"), twice.alias("duplicates"), rate.alias("duplicate_rate"))


def duplicates_for_output(marked: DataFrame) -> DataFrame:
    return filter_header(filter_empty(marked.where("is_duplicate")))


# --- order -----------------------------------------------------------------------------


def with_parsed_date(df: DataFrame, hint: str | None = "statement_year") -> DataFrame:
    year = F.col(hint).try_cast("int") if hint else None
    return df.withColumn("parsed_date", dates.parse_date(F.col("date"), year))


def chronological(df: DataFrame, order: Sequence[str] = ("ord",), hint: str | None = "statement_year") -> DataFrame:
    """By date, unreadable dates first, ties in input order."""
    return with_parsed_date(df, hint).orderBy("parsed_date", *order)


def chronological_rank(df: DataFrame, account: str, order: Sequence[str] = ("ord",), hint: str | None = "statement_year") -> DataFrame:
    window = Window.partitionBy(account).orderBy("parsed_date", *order)
    return with_parsed_date(df, hint).withColumn("position", F.row_number().over(window))


def process_accounts(df: DataFrame, files: DataFrame, key: Column | None = None, order: str = "ord") -> DataFrame:
    """The group pipeline: file name, account, type, duplicate mark and parsed date of every row."""
    grouped = by_iban(enrich(df), files)
    typed = classify_types(grouped, "account_suffix", (order,))
    return with_parsed_date(mark_duplicates(typed, key_all_fields() if key is None else key, "account_suffix", order))
