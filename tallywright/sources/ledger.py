"""Statement inputs made from the driver's tables.

Each adapter is a list of SQL expressions that Spark and DuckDB read alike, so
a query and its oracle start from the same rows. All rows of a table are used.
Spark makes an adapter's cells once a row: they pass a generator, through which
the optimiser doesn't copy them into each filter and column that uses them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', (month(o_orderdate) - 1) * 3 + 1, 3)"
_MONTH = (
    "CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April'"
    " WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September'"
    " WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END"
)
_D = "CAST(day(o_orderdate) AS STRING)"
_DD = f"lpad({_D}, 2, '0')"
_M = "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"
_Y = "CAST(year(o_orderdate) AS STRING)"
_YY = f"substr({_Y}, 3, 2)"
_DATE = (
    f"CASE o_orderkey % 7 WHEN 0 THEN concat({_DD}, '/', {_M}, '/', {_Y}) WHEN 1 THEN concat({_D}, '/', {_M}, '/', {_YY})"
    f" WHEN 2 THEN concat({_D}, ' ', {_MON}, ' ', {_Y}) WHEN 3 THEN concat({_DD}, '-', {_M}, '-', {_Y})"
    f" WHEN 4 THEN concat({_DD}, upper({_MON}), {_Y}) WHEN 5 THEN concat({_D}, '  ', {_MONTH}, ' ', {_Y})"
    f" ELSE concat({_D}, ' ', {_MON}) END"
)
_WORD = (
    "CASE o_orderkey % 9 WHEN 0 THEN 'CONTACTLESS PURCHASE' WHEN 1 THEN 'DIRECT DEBIT' WHEN 2 THEN 'SEPA TRANSFER'"
    " WHEN 3 THEN 'INTEREST PAID' WHEN 4 THEN 'MAINTENANCE FEE' WHEN 5 THEN 'REFUND' WHEN 6 THEN 'STANDING ORDER'"
    " WHEN 7 THEN 'Card payment' ELSE 'Misc' END"
)
#: One order in 499 is far above the others.
_CENTS = "CAST(round(o_totalprice * CASE WHEN o_orderkey % 499 = 0 THEN 4000 ELSE 100 END) AS BIGINT)"
_WHOLE = f"CAST(floor({_CENTS} / 100) AS BIGINT)"
_REST = f"lpad(CAST({_CENTS} % 100 AS STRING), 2, '0')"
_PLAIN = f"concat(CAST({_WHOLE} AS STRING), '.', {_REST})"
_GROUPED = (
    f"CASE WHEN {_WHOLE} >= 1000 THEN concat(CAST(CAST(floor({_WHOLE} / 1000) AS BIGINT) AS STRING), ',',"
    f" lpad(CAST({_WHOLE} % 1000 AS STRING), 3, '0'), '.', {_REST}) ELSE {_PLAIN} END"
)
_AMOUNT = (
    f"CASE o_orderkey % 8 WHEN 0 THEN {_PLAIN} WHEN 1 THEN concat('€', {_GROUPED}) WHEN 2 THEN concat('(', {_PLAIN}, ')')"
    f" WHEN 3 THEN {_GROUPED} WHEN 4 THEN concat(' £', {_PLAIN}, ' ') WHEN 5 THEN concat('-', {_PLAIN})"
    f" WHEN 6 THEN 'n/a' ELSE {_PLAIN} END"
)
_BLANK = "o_orderkey % 97 = 0"
_BALANCE_ONLY = "o_orderkey % 89 = 0"
_HEADER = "o_orderkey % 83 = 0"
_FILE = "concat('stmt_', CAST(o_custkey % 40 AS STRING), '.pdf')"

LEDGER = {
    "ord": "o_orderkey",
    "file_ord": "o_custkey % 40",
    "filename": _FILE,
    "document_type": "CASE o_custkey % 40 % 3 WHEN 0 THEN 'bank_statement' WHEN 1 THEN 'credit_card_statement' ELSE 'loan_statement' END",
    "statement_year": _Y,
    "date": f"CASE WHEN {_BLANK} OR {_BALANCE_ONLY} THEN '' WHEN {_HEADER} THEN 'Date' WHEN o_orderkey % 79 = 0 THEN 'Account total' ELSE {_DATE} END",
    "details": f"CASE WHEN {_BLANK} OR {_BALANCE_ONLY} THEN '' WHEN {_HEADER} THEN 'Details' ELSE concat({_WORD}, ' ', o_orderpriority) END",
    "debit": f"CASE WHEN {_BLANK} OR {_BALANCE_ONLY} THEN '' WHEN {_HEADER} THEN 'Debit' WHEN o_orderkey % 11 = 0 THEN concat({_PLAIN}, 'CR') WHEN o_orderkey % 3 <> 1 THEN {_AMOUNT} ELSE '' END",
    "credit": f"CASE WHEN {_BLANK} OR {_BALANCE_ONLY} THEN '' WHEN {_HEADER} THEN 'Credit' WHEN o_orderkey % 3 = 1 AND o_orderkey % 11 <> 0 THEN {_AMOUNT} ELSE '' END",
    "balance": f"CASE WHEN {_BLANK} OR o_orderkey % 7 = 0 THEN '' WHEN {_HEADER} THEN 'Balance' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END",
}
_BASE = "FROM orders JOIN customer ON o_custkey = c_custkey"
LEDGER_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in LEDGER.items()) + " " + _BASE

#: Every row once more from a second file. One in three carries the same cells; others differ in their date or amount.
_COPY = {n: n for n in LEDGER} | {
    "ord": "ord + 1000000000",
    "filename": "CASE WHEN ord % 33 = 0 THEN filename ELSE concat('copy_', filename) END",
    "date": "CASE WHEN ord % 3 = 1 THEN concat(date, ' ') ELSE date END",
    "debit": "CASE WHEN ord % 3 = 2 THEN concat('1', debit) ELSE debit END",
}
DUPLICATED_SQL = f"SELECT * FROM ({LEDGER_SQL}) l UNION ALL SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COPY.items()) + f" FROM ({LEDGER_SQL}) l"

#: One row for each statement file. Countries and lengths vary, so that some numbers are not valid.
_DIGITS = "lpad(CAST(file_ord * 7919 + 12345 AS STRING), 20, '3')"
FILES = {
    "filename": "filename",
    "document_type": "document_type",
    "iban": (
        f"CASE file_ord % 5 WHEN 0 THEN concat('IE29AIBK', substr({_DIGITS}, 7, 14)) WHEN 1 THEN concat('DE89', substr({_DIGITS}, 3, 18))"
        f" WHEN 2 THEN concat('GB29 NWBK ', substr({_DIGITS}, 7, 14)) WHEN 3 THEN concat('FR14', substr({_DIGITS}, 3, 12)) ELSE NULL END"
    ),
    "card": f"CASE WHEN file_ord % 3 = 1 THEN concat('**** **** **** ', substr({_DIGITS}, 17, 4)) ELSE NULL END",
    "pages": "CAST(file_ord % 4 + 1 AS BIGINT)",
}
FILES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in FILES.items()) + f" FROM (SELECT DISTINCT file_ord, filename, document_type FROM ({LEDGER_SQL}) l) f"

#: Charges of 30 vendors, one of which has no name: half of them monthly, some of these of too different amounts.
_SEQ = "CAST(floor(o_orderkey / 30) AS INT)"
_DAY = f"DATE '2010-01-03' + CAST({_SEQ} * CASE WHEN o_orderkey % 30 < 15 THEN 30 ELSE 45 END + o_orderkey % 3 AS INT)"
CHARGES = {
    "ord": "o_orderkey",
    "details": "CASE o_orderkey % 30 WHEN 7 THEN '' ELSE concat('vendor ', CAST(o_orderkey % 30 AS STRING)) END",
    "day": _DAY,
    "statement_year": "CAST(NULL AS STRING)",
    "debit": f"concat(CAST(20 + o_orderkey % 30 + CASE WHEN o_orderkey % 30 % 5 = 4 THEN {_SEQ} % 7 ELSE 0 END AS STRING), '.', lpad(CAST({_SEQ} % 37 AS STRING), 2, '0'))",
    "credit": "''",
}
CHARGES_SQL = "SELECT *, concat(lpad(CAST(day(day) AS STRING), 2, '0'), '/', lpad(CAST(month(day) AS STRING), 2, '0'), '/', CAST(year(day) AS STRING)) AS date FROM (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CHARGES.items()) + " FROM orders) c"

#: Words of statement pages from line items: a page holds the lines of some orders, a line has up to five cells.
_LINE = "CAST(floor(l_orderkey / 8) AS BIGINT)"
_WORD_BASE = {
    "file": "concat('f', CAST(l_suppkey % 10 AS STRING))",
    "page_no": _LINE,
    "top": "300 + ((l_orderkey % 8) * 7 + l_linenumber) * 9 + l_discount * 4",
}
_CELLS = (
    (1, 30, "CASE WHEN l_linenumber = 1 THEN concat(lpad(CAST(day(l_shipdate) AS STRING), 2, '0'), '/', lpad(CAST(month(l_shipdate) AS STRING), 2, '0'), '/', CAST(year(l_shipdate) AS STRING)) ELSE '' END"),
    (2, 80, "CASE WHEN l_linenumber % 4 = 3 THEN 'Ref: 123456' WHEN l_linenumber % 4 = 0 THEN 'BALANCE' WHEN l_quantity > 40 THEN 'VDP-SHOP' ELSE 'Payment' END"),
    (3, 160, "CASE WHEN l_linenumber % 4 = 0 THEN 'FORWARD' WHEN l_linenumber % 4 = 3 THEN '' ELSE concat('no', CAST(l_partkey % 50 AS STRING)) END"),
    (4, 260, "CASE WHEN l_linenumber % 4 IN (1, 2) AND l_returnflag <> 'R' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) ELSE '' END"),
    (5, 320, "CASE WHEN l_linenumber % 4 IN (1, 2) AND l_returnflag = 'R' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) ELSE '' END"),
    (6, 380, "CASE WHEN l_linenumber % 4 = 1 THEN CAST(CAST(l_quantity * 10 AS DECIMAL(18,2)) AS STRING) ELSE '' END"),
)
_SEQ_OF, _RIGHT, _BELOW = "(l_orderkey * 8 + l_linenumber) * 10 + {k}", "{x} + l_tax * 100", f"{_WORD_BASE['top']} + 8"
WORDS_SQL = " UNION ALL ".join(
    "SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _WORD_BASE.items())
    + f", {_SEQ_OF.format(k=k)} AS word_seq, {text} AS text, {_RIGHT.format(x=x)} AS x0, {_RIGHT.format(x=x)} + 30 AS x1, {_BELOW} AS bottom"
    + f" FROM lineitem WHERE {text} <> ''"
    for k, x, text in _CELLS
)
#: A heading over every page's lines, a closing line on some pages, and lines between of too few words to count.
_HEADING = ((0, 30, "Date"), (1, 80, "Details"), (2, 260, "Debit"), (3, 320, "Credit"), (4, 380, "Balance"))
_CLOSING = ((5, 30, "Thank"), (6, 70, "you"))
HEADED_SQL = (
    f"SELECT * FROM ({WORDS_SQL}) w"
    + "".join(
        f" UNION ALL SELECT file, page_no, {place} AS top, s {sign} {1 + k} AS word_seq, '{text}' AS text, CAST({x} AS DOUBLE) AS x0, CAST({x + 35} AS DOUBLE) AS x1, {place} + 8 AS bottom FROM edges{test}"
        for words, place, sign, test in ((_HEADING, "lo - 12", "- 9 +", ""), (_CLOSING, "hi + 40", "+ 9 +", " WHERE page_no % 3 = 0"))
        for k, x, text in words
    )
)


#: First pages of documents: web pages with statement phrases before them.
_PHRASE = (
    "CASE page_id % 8 WHEN 0 THEN 'Your Loan Ref: LN-4411 mortgage ' WHEN 1 THEN 'Card Number: **** **** **** 4242 Credit Limit 5000 '"
    " WHEN 2 THEN 'IBAN: IE29AIBK93115212345678 Statement of Account ' WHEN 3 THEN 'Payment Due Date: 12th March, 2024 VISA Card Statement '"
    " WHEN 4 THEN 'Date Details Debit Credit Balance ' WHEN 5 THEN 'DRAFT ONLY IBAN: IE12BOFI90001112345678 '"
    " WHEN 6 THEN 'Mortgage Account: 778-12 loan statement ' ELSE '' END"
)
PAGES = {
    "file": "concat('doc_', CAST(page_id AS STRING), CASE WHEN page_id % 3 = 0 THEN '_aib.pdf' ELSE '.pdf' END)",
    "page_no": "1",
    "text": f"concat({_PHRASE}, coalesce(html, ''))",
}
PAGES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in PAGES.items()) + " FROM pages"


def _tables(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    for name in tables:  # names of this module's own, so that no user's view is hidden
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"tallywright_{name}")
        sql = sql.replace(f"FROM {name}", f"FROM tallywright_{name}").replace(f"JOIN {name}", f"JOIN tallywright_{name}")
    return spark.sql(sql)


def _once(df: DataFrame) -> DataFrame:
    """The same rows, their cells made once."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(_tables(spark, sf_dir, LEDGER_SQL, ("orders", "customer")))


def duplicated_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row and its copy come from one scan."""
    both = F.array(F.struct(*[F.expr(n).alias(n) for n in _COPY]), F.struct(*[F.expr(e).alias(n) for n, e in _COPY.items()]))
    rows = ledger(spark, sf_dir).withColumn("ord", F.col("ord").cast("long"))
    return rows.select(F.inline(both))


def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir, FILES_SQL, ("orders", "customer"))


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(_tables(spark, sf_dir, CHARGES_SQL, ("orders",)))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of the line items gives all cells of a line."""
    line = _tables(spark, sf_dir, "SELECT * FROM lineitem", ("lineitem",))
    base = {n: F.expr(e).alias(n) for n, e in _WORD_BASE.items()}
    cells = [
        F.struct(
            F.expr(_SEQ_OF.format(k=k)).alias("word_seq"),
            F.expr(text).alias("text"),
            F.expr(_RIGHT.format(x=x)).alias("x0"),
            F.expr(f"{_RIGHT.format(x=x)} + 30").alias("x1"),
            F.expr(_BELOW).alias("bottom"),
        )
        for k, x, text in _CELLS
    ]
    return line.select(*base.values(), F.inline(F.array(*cells))).where("text <> ''")


def headed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with headings and closing lines around them."""
    body = words(spark, sf_dir)
    edges = body.groupBy("file", "page_no").agg(F.min("word_seq").alias("s"), F.min("top").alias("lo"), F.max("top").alias("hi"))
    parts = []
    for listed, place, sign in ((_HEADING, "lo - 12", -9), (_CLOSING, "hi + 40", 9)):
        for k, x, name in listed:
            parts.append(
                F.struct(
                    F.expr(place).alias("top"), (F.col("s") + sign + 1 + k).alias("word_seq"), F.lit(name).alias("text"),
                    F.lit(float(x)).alias("x0"), F.lit(float(x + 35)).alias("x1"), F.expr(f"{place} + 8").alias("bottom"),
                )
            )
    head = len(_HEADING)
    chosen = F.when(F.col("page_no") % 3 == 0, F.array(*parts)).otherwise(F.array(*parts[:head]))
    return body.unionByName(edges.select("file", "page_no", F.inline(chosen)))


def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(_tables(spark, sf_dir, PAGES_SQL, ("pages",)))
