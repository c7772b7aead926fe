"""Row classification, page validation, merging and forward fill.

Rows have file, page_no, row_no and the cells date, details, debit, credit and
balance as text; an empty cell is an empty text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import amounts, dates, text

CELLS = ("date", "details", "debit", "credit", "balance")
# Shapes of header and metadata rows, on the lower-cased text of the row.
HEADER_SHAPES = [
    r"'?\w*date'?\s*\([^)]*date[^)]*\)",
    r"'?\w*date'?\s*\([^)]*\)",
    r"\btxndate\b",
    r"\btransactiondate\b",
    r"\bcolumn\s*header\b",
    r"\bfield\s*name\b",
    r"\btable\s*header\b",
    r"'[^']*'\([^)]*\)",
]
# Cells of header rows, and words that rule a date cell out.
HEADER_CELLS = ["date", "details", "amount", "balance", "debit", "credit", "reference"]
DATE_HEADERS = ["txndate", "transactiondate", "field", "column", "amount(", "balance(", "debit(", "credit(", "date("]
# Shapes of dates.
DATE_SHAPES = [
    r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$",
    r"^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}$",
    r"^\d{1,2}\s+[A-Za-z]{3,9}$",
    r"^\d{1,2}[A-Z]{3}\d{2,4}$",
]
# Shapes of foreign-exchange lines, and prefixes of transactions.
EXCHANGE_SHAPES = [r"^\d+\.\d+\s+GBP@$", r"^\d+\.\d{6,}$", r"^INCL FX FEE\s+[€E]\d+\.\d+$", r"^\d+@\s+\d+\.\d+\s+EACH$"]
PREFIXES = ["VDC-", "VDP-", "VDA-", "ATM", "D/D"]
# Words of page headers.
PAGE_HEADER_WORDS = [
    "date",
    "trans date",
    "transaction date",
    "posting date",
    "value date",
    "details",
    "description",
    "particulars",
    "narrative",
    "amount",
    "debit",
    "dr",
    "withdrawal",
    "payments",
    "credit",
    "cr",
    "deposit",
    "lodgement",
    "balance",
    "running balance",
    "closing balance",
    "transaction",
    "reference",
    "ref",
    "ref no",
    "memo",
]
# Weights of the completeness score and penalties of confidence.
WEIGHTS = {"date": 0.2, "details": 0.3, "debit": 0.25, "credit": 0.25, "balance": 0.2}
DATE_PENALTY, BALANCE_PENALTY = 0.1, 0.2


def looks_like_date(value: Column) -> Column:
    return text.matches_any(text.strip(value), DATE_SHAPES)


def _filled(name: str) -> Column:
    return ~text.is_blank(F.col(name))


def rules(cells: Sequence[str] = CELLS) -> list[tuple[int, str, Column]]:
    """(priority, label, condition); the first that holds labels the row. Callers may add their own."""
    details = text.strip(F.col("details"))
    whole = F.lower(text.join_nonempty([text.strip(F.col(c)) for c in cells]))
    each = F.filter(F.array(*[F.lower(text.strip(F.col(c))) for c in cells]), lambda c: c != "")
    heading = F.exists(
        each,
        lambda c: (c.startswith("'") & F.contains(c, F.lit("("))) | c.rlike(r"^\w+(date|time|amount|balance|detail)") | c.isin(*HEADER_CELLS),
    )
    money = _filled("debit") | _filled("credit")
    dated = looks_like_date(F.col("date")) & ~text.contains_any(F.lower("date"), DATE_HEADERS)
    prefixed = F.coalesce(details.rlike("^(" + "|".join(text.java_quote(p) for p in PREFIXES) + ")"), F.lit(False))
    return [
        (0, "metadata", text.matches_any(whole, HEADER_SHAPES) | heading),
        (
            1,
            "administrative",
            F.contains(details, F.lit("Lending @"))
            | (F.contains(details, F.lit("BALANCE FORWARD")) & ~_filled("balance"))
            | (F.contains(details, F.lit("Interest Rate")) & ~money),
        ),
        (2, "reference", details.rlike(r"^IE\d+$")),
        (3, "continuation", details.rlike(r"(?i)^Ref\s*:\s*\d+")),
        (4, "continuation", text.matches_any(details, EXCHANGE_SHAPES) & ~money),
        (5, "metadata", details.rlike(r"\d{2}[A-Z]{3}\d{2,4}\s+TIME\s+\d{2}:\d{2}")),
        (6, "transaction", money | prefixed | dated | (_filled("balance") & (details != ""))),
    ]


def row_type(chain: list[tuple[int, str, Column]] | None = None) -> Column:
    chain = sorted(chain or rules(), key=lambda r: r[0])
    if len({r[0] for r in chain}) < len(chain):
        raise ValueError("two rules have the same priority")
    return F.coalesce(*[F.when(condition, label) for _, label, condition in chain], F.lit("metadata"))


def completeness() -> Column:
    """Filled weights and bonuses for long details and well-formed money, over all weights, at most 1."""
    parts = []
    for name, weight in WEIGHTS.items():
        value = text.strip(F.col(name))
        good = (F.length(value) > 5) if name == "details" else value.rlike(r"^\d+\.\d{2}$") if name != "date" else F.lit(False)
        bonus = 0.2 if name == "details" else 0.3
        parts.append(F.when(value != "", weight + F.when(good, weight * bonus).otherwise(0.0)).otherwise(0.0))
    return F.least(F.lit(1.0), sum(parts, F.lit(0.0)) / sum(WEIGHTS.values()))


def validate_pages(table: DataFrame, least_rows: int = 1, coverage: float = 0.2, ratio: float = 0.1) -> DataFrame:
    """(file, page_no, rows, coverage, ratio, valid) of every page."""
    filled = [F.max(F.when(_filled(c), 1).otherwise(0)) for c in CELLS]
    counted = table.groupBy("file", "page_no").agg(
        F.count("*").alias("n_rows"),
        (sum(filled, F.lit(0)) / len(CELLS)).alias("coverage"),
        F.avg(F.when(F.col("row_type") == "transaction", 1.0).otherwise(0.0)).alias("ratio"),
    )
    return counted.withColumn("valid", (F.col("n_rows") >= least_rows) & (F.col("coverage") >= coverage) & (F.col("ratio") >= ratio))


def valid_pages_only(table: DataFrame) -> DataFrame:
    valid = validate_pages(table).where("valid").select("file", "page_no")
    return table.join(valid, ["file", "page_no"], "left_semi")


def detect_headers(words: DataFrame, least: int = 2, lines: int = 5) -> DataFrame:
    """Whether one of a page's first lines has two header words or more, as substrings."""
    from tallywright.operators.layout import lines_by_y

    rank = F.row_number().over(Window.partitionBy("file", "page_no").orderBy("y_key"))
    low = F.lower(F.col("line"))
    hits = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in PAGE_HEADER_WORDS), F.lit(0))
    found = lines_by_y(words).withColumn("rank", rank).where(F.col("rank") <= lines).withColumn("hits", hits)
    return found.groupBy("file", "page_no").agg(F.max("hits").alias("header_words"), (F.max("hits") >= least).alias("has_header"))


def carry_split_dates(table: DataFrame) -> DataFrame:
    """A transaction row with nothing but a date hands it to a dateless transaction right after it and goes."""
    order = Window.partitionBy("file", "page_no").orderBy("row_no")
    is_row = F.col("row_type") == "transaction"
    only_date = is_row & _filled("date") & ~(_filled("details") | _filled("debit") | _filled("credit") | _filled("balance"))
    open_row = is_row & ~_filled("date")
    marked = table.withColumns({"only_date": only_date, "open_row": open_row})
    linked = marked.withColumns(
        {
            "gives": F.col("only_date") & F.coalesce(F.lead("open_row").over(order), F.lit(False)),
            "given": F.when(F.col("open_row") & F.coalesce(F.lag("only_date").over(order), F.lit(False)), F.lag("date").over(order)),
        }
    )
    return linked.where(~F.col("gives")).withColumn("date", F.coalesce("given", "date")).drop("only_date", "open_row", "gives", "given")


def merge_continuations(table: DataFrame) -> DataFrame:
    """Continuations join the transaction before them: details are appended, a missing balance is filled; orphans go.

    A continuation belongs to a transaction only while nothing else stands
    between them.
    """
    order = Window.partitionBy("file", "page_no").orderBy("row_no")
    follows = F.col("row_type") == "continuation"
    split = carry_split_dates(table).withColumn("group", F.sum(F.when(follows, 0).otherwise(1)).over(order))
    part = F.struct("row_no", "details")
    listed = F.array_sort(F.collect_list(F.when(~text.is_blank(F.col("details")), part)))
    tail_balance = F.min(F.when(follows & _filled("balance"), F.struct("row_no", "balance")))["balance"]
    first = lambda c: F.max(F.when(~follows, F.col(c)))
    merged = split.groupBy("file", "page_no", "group").agg(
        F.min("row_no").alias("row_no"),
        first("row_type").alias("row_type"),
        first("date").alias("date"),
        F.array_join(F.transform(listed, lambda p: text.strip(p["details"])), " ").alias("details"),
        first("debit").alias("debit"),
        first("credit").alias("credit"),
        first("balance").alias("own_balance"),
        tail_balance.alias("tail_balance"),
    )
    return merged.where("row_type is not null").select(
        "file",
        "page_no",
        "row_no",
        "row_type",
        "date",
        "details",
        "debit",
        "credit",
        F.when(~text.is_blank(F.col("own_balance")) | F.col("tail_balance").isNull(), F.col("own_balance")).otherwise(F.col("tail_balance")).alias("balance"),
    )


def rename_aliases(table: DataFrame, aliases: dict[str, str]) -> DataFrame:
    return table.withColumnsRenamed({k: v for k, v in aliases.items() if k in table.columns})


def post_process(table: DataFrame, has_balance: bool = True, date_penalty: float = DATE_PENALTY, balance_penalty: float = BALANCE_PENALTY) -> DataFrame:
    """Dates fill forward over the pages of a file (the file name's date before the first), with confidence and warnings."""
    if date_penalty < 0 or balance_penalty < 0:
        raise ValueError("penalties must not be negative")
    debit, credit = amounts.reroute_credit(F.col("debit"), F.col("credit"))
    routed = table.withColumns({"debit": debit, "credit": credit}).withColumn("row_type", row_type())
    is_row = F.col("row_type") == "transaction"
    own = F.when(is_row & _filled("date"), F.col("date"))
    order = Window.partitionBy("file").orderBy("page_no", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    from_name = F.when(dates.filename_date(F.col("file")) != "", dates.filename_date(F.col("file")))
    filled = F.coalesce(F.last(own, ignorenulls=True).over(order), from_name)
    carried = is_row & own.isNull() & filled.isNotNull()
    bare = is_row & F.lit(has_balance) & ~_filled("balance")
    warning = lambda condition, code, message: F.when(
        condition, F.struct(F.lit(code).alias("code"), message.alias("message"), F.col("page_no").cast("int").alias("page"))
    )
    marked = routed.withColumns({"_filled": filled, "_carried": carried, "_bare": bare})
    return marked.select(
        *[c for c in routed.columns if c != "date"],
        F.when(F.col("_carried"), F.col("_filled")).otherwise(F.col("date")).alias("date"),
        F.when(is_row, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.when(F.col("_carried"), date_penalty).otherwise(0.0) - F.when(F.col("_bare"), balance_penalty).otherwise(0.0)))).alias("confidence_score"),
        F.array_compact(
            F.array(
                warning(F.col("_carried"), "DATE_PROPAGATED", F.concat(F.lit("date propagated from previous row ('"), F.col("_filled"), F.lit("')"))),
                warning(F.col("_bare"), "MISSING_BALANCE", F.lit("balance field is missing or empty")),
            )
        ).alias("extraction_warnings"),
    )
