"""DuckDB SQL of the ledger queries, written on its own from the same adapters."""

from __future__ import annotations

from tallywright.functions.iban import LENGTHS
from tallywright.sources.ledger import CHARGES_SQL, DUPLICATED_SQL, FILES_SQL, HEADED_SQL, LEDGER_SQL, PAGES_SQL, WORDS_SQL

L = f"WITH l AS ({LEDGER_SQL})"
_DEC = "DECIMAL(38,10)"
DEBIT, CREDIT = "debit", "credit"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def blank(c: str) -> str:
    return f"(coalesce({strip(c)}, '') = '')"


def bare(c: str) -> str:
    return f"regexp_replace({c}, '[€$£¥\\s,]', '', 'g')"


NUMBER = "'^(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$'"


def to_float(c: str) -> str:
    s = strip(c)
    wrapped = f"regexp_matches({s}, '^\\(.*\\)$')"
    inner = bare(f"CASE WHEN {wrapped} THEN substr({s}, 2, length({s}) - 2) ELSE {s} END")
    digits = f"regexp_replace({inner}, '^[+-]', '')"
    return (
        f"CASE WHEN regexp_matches({digits}, {NUMBER}) THEN"
        f" CASE WHEN {wrapped} OR starts_with({inner}, '-') THEN -TRY_CAST({digits} AS DOUBLE) ELSE TRY_CAST({digits} AS DOUBLE) END END"
    )


def to_decimal(c: str) -> str:
    s = f"CASE WHEN {bare(c)} = '' THEN '0' ELSE {bare(c)} END"
    return f"CASE WHEN regexp_matches(regexp_replace({s}, '^[+-]', ''), {NUMBER}) THEN TRY_CAST({s} AS {_DEC}) END"


def amount() -> str:
    return f"abs(CASE WHEN NOT {blank('debit')} THEN -({to_decimal('debit')}) WHEN NOT {blank('credit')} THEN {to_decimal('credit')} END)"


def parse_date(c: str, hint: str | None = None) -> str:
    s = strip(f"regexp_replace({c}, '\\s+', ' ', 'g')")
    s = f"regexp_replace({s}, '\\bSept\\b', 'Sep', 'g')"
    two = lambda f: f"CASE WHEN regexp_matches({s}, '(^|[^0-9])[0-9][0-9]$') THEN TRY_STRPTIME({s}, '{f}') END"
    four = lambda f: f"CASE WHEN regexp_matches({s}, '(^|[^0-9])[0-9][0-9][0-9][0-9]$') THEN TRY_STRPTIME({s}, '{f}') END"
    pivot = lambda e: f"CASE WHEN year({e}) >= 2050 THEN {e} - INTERVAL 100 YEAR WHEN year({e}) < 1950 THEN {e} + INTERVAL 100 YEAR ELSE {e} END"
    tried = []
    for d in ("/", "-"):
        tried += [pivot(two(f"%d{d}%m{d}%y")), four(f"%d{d}%m{d}%Y")]
    tried += [four("%d %b %Y"), four("%d %B %Y"), pivot(two("%d %b %y")), pivot(two("%d %B %y"))]
    tried += [pivot(two("%d%b%y")), pivot(two("%d%B%y")), four("%d%b%Y"), four("%d%B%Y")]
    if hint:
        made = lambda f: f"TRY_STRPTIME(concat({s}, ' ', {hint}), '{f} %Y')"
        tried.append(f"CASE WHEN regexp_matches({s}, '^\\d{{1,2}}\\s+[A-Za-z]{{3,}}$') AND lower(replace({s}, ' ', '')) NOT LIKE '29feb%' THEN coalesce({made('%d %b')}, {made('%d %B')}) END")
    return f"coalesce({', '.join(f'CAST({t} AS DATE)' for t in tried)}, DATE '1970-01-01')"


def add_year(c: str = "date", y: str = "statement_year") -> str:
    return f"CASE WHEN regexp_matches({c}, '^\\d{{1,2}}\\s+[A-Za-z]{{3,}}$') AND {y} IS NOT NULL THEN concat({c}, ' ', {y}) ELSE {c} END"


def words_like(c: str, words: list[str]) -> str:
    q = lambda w: w.replace("'", "''")
    return "(" + " OR ".join(f"contains(coalesce({c}, ''), '{q(w)}')" for w in words) + ")"


def shapes(c: str, patterns: list[str]) -> str:
    q = lambda p: p.replace("'", "''")
    return "(" + " OR ".join(f"coalesce(regexp_matches({c}, '{q(p)}'), false)" for p in patterns) + ")"


def even(e: str) -> str:
    """Two places, ties to even, of a decimal."""
    return f"CAST(round_even(CAST({e} AS {_DEC}), 2) AS DOUBLE)"


EMPTY = f"({blank('details')} AND {blank('debit')} AND {blank('credit')} AND ({blank('date')} OR NOT {blank('balance')}))"
_NAMES = ["date", "details", "debit", "credit", "balance", "filename"]
_CELLS = ["date", "details", "debit", "credit", "balance"]


def _header() -> str:
    hit = lambda c: "(" + " OR ".join(f"contains(v_{c}, '{n}') OR contains('{n}', v_{c})" for n in _NAMES) + ")"
    filled = " + ".join(f"CASE WHEN v_{c} <> '' THEN 1 ELSE 0 END" for c in _CELLS)
    hits = " + ".join(f"CASE WHEN v_{c} <> '' AND {hit(c)} THEN 1 ELSE 0 END" for c in _CELLS)
    return f"(({filled}) >= 2 AND ({hits}) * 2 >= ({filled}))"


_CLEAN = f"c AS (SELECT *, {', '.join(f'lower({strip(c)}) AS v_{c}' for c in _CELLS)} FROM l)"
NOT_DATES = ["product", "account", "total", "balance", "transaction", "statement", "details", "debit", "credit", "description"]
SIGNS = ["/", "-", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DATED = f"(NOT {blank('date')} AND NOT {words_like('lower(date)', NOT_DATES)} AND length(date) <= 25 AND ({words_like('lower(date)', SIGNS)} OR regexp_matches(replace(date, ' ', ''), '^\\d+$')))"

# Keyword lists, in the order of trial.
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


def by_words(words: dict) -> str:
    return "CASE " + " ".join(f"WHEN {words_like('upper(details)', ws)} THEN '{k}'" for k, ws in words.items()) + " END"


def by_amount() -> str:
    d, c = (f"coalesce({to_float(x)}, 0)" for x in ("debit", "credit"))
    card = "document_type = 'credit_card_statement'"
    return (
        f"CASE WHEN {c} > 0 AND {d} = 0 THEN CASE WHEN {card} THEN 'refund' ELSE 'transfer' END"
        f" WHEN {d} > 0 AND {c} = 0 THEN CASE WHEN {card} THEN 'purchase' ELSE 'payment' END WHEN {d} = 0 AND {c} = 0 THEN 'fee' END"
    )


def typed(source: str = "l") -> str:
    chain = (
        f"coalesce(CASE WHEN document_type = 'credit_card_statement' THEN {by_words(CARD_WORDS)} WHEN document_type = 'bank_statement' THEN {by_words(BANK_WORDS)} END,"
        f" {by_amount()}, 'other')"
    )
    return f"SELECT *, {chain} AS transaction_type FROM {source}"


def valued() -> str:
    return f"v AS (SELECT *, {amount()} AS amount FROM l)"


STATS = (
    f"s AS (SELECT coalesce(round(avg(CAST(amount AS DOUBLE)), 2), 0) AS mean_amount, coalesce(round(median(CAST(amount AS DOUBLE)), 2), 0) AS median_amount,"
    f" coalesce(round(stddev_samp(CAST(amount AS DOUBLE)), 2), 0) AS std_amount,"
    f" coalesce({even(f'sum(CASE WHEN NOT {blank(DEBIT)} THEN amount END)')}, 0) AS total_debits,"
    f" coalesce({even(f'sum(CASE WHEN {blank(DEBIT)} THEN amount END)')}, 0) AS total_credits FROM v WHERE amount > 0)"
)

# the mean in whole cents, ties to even, from exact sums
_S, _N = "CAST(sum(CASE WHEN amount > 0 THEN amount END) * 100 AS HUGEINT)", "count(CASE WHEN amount > 0 THEN 1 END)"
_AVERAGE = f"CAST({_S} // {_N} + CASE WHEN 2 * ({_S} % {_N}) > {_N} OR (2 * ({_S} % {_N}) = {_N} AND ({_S} // {_N}) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100"
_D = f"WITH l AS ({DUPLICATED_SQL})"
_F = f"f AS ({FILES_SQL})"


def _marked(key: str, account: str = "") -> str:
    return (
        f"k AS (SELECT *, {key} AS key FROM t), m AS (SELECT *, filename <> first_value(filename) OVER (PARTITION BY key{account} ORDER BY ord) AS is_duplicate FROM k)"
    )


def money(e: str) -> str:
    return f"CAST(CAST(round_even(CAST({e} AS {_DEC}), 2) AS DECIMAL(38,2)) AS VARCHAR)"


_NUMERIC = ["debit", "credit", "balance"]
KEY_ALL = "concat_ws(':', date, details, " + ", ".join(f"coalesce(CAST({to_float(c)} AS VARCHAR), '~')" for c in _NUMERIC) + ")"
KEY_SUM = "concat_ws(':', date, " + money(" + ".join(f"abs(coalesce({to_float(c)}, 0))" for c in _NUMERIC)) + ")"
KEY_CARD = f"concat_ws(':', date, transaction_type, {money(f'coalesce({to_float(DEBIT)}, {to_float(CREDIT)}, 0)')})"

# --- words -----------------------------------------------------------------------------

W = f"WITH w AS ({WORDS_SQL})"
_RANGES = {"date": (26, 78), "details": (78, 255), "debit": (255, 313), "credit": (313, 369), "balance": (369, 434)}


def cells(strict: bool) -> str:
    last = "x0 >= 369 AND x1 <= 434" if strict else "x0 >= 369 AND x0 < 434"
    tests = [f"WHEN x0 >= {lo} AND x0 < {hi} THEN '{n}'" if n != "balance" else f"WHEN {last} THEN 'balance'" for n, (lo, hi) in _RANGES.items()]
    parts = ", ".join(f"coalesce({strip(f'''string_agg(text, ' ' ORDER BY word_seq, text) FILTER (WHERE col = '{n}')''')}, '') AS {n}" for n in _RANGES)
    return f"SELECT file, page_no, y_key, {parts} FROM (SELECT *, round_even(top, 0) AS y_key, CASE {' '.join(tests)} END AS col FROM w) GROUP BY 1, 2, 3"


DATE_SHAPES = ["^\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}$", "^\\d{1,2}\\s+[A-Za-z]{3,9}\\s+\\d{2,4}$", "^\\d{1,2}\\s+[A-Za-z]{3,9}$", "^\\d{1,2}[A-Z]{3}\\d{2,4}$"]
# Shapes of header rows.
HEADER_SHAPES = [
    "'?\\w*date'?\\s*\\([^)]*date[^)]*\\)",
    "'?\\w*date'?\\s*\\([^)]*\\)",
    "\\btxndate\\b",
    "\\btransactiondate\\b",
    "\\bcolumn\\s*header\\b",
    "\\bfield\\s*name\\b",
    "\\btable\\s*header\\b",
    "'[^']*'\\([^)]*\\)",
]


def row_type() -> str:
    f = lambda c: f"({strip(c)} <> '')"
    whole = "lower(concat_ws(' ', " + ", ".join(f"nullif({strip(c)}, '')" for c in _CELLS) + "))"
    low = lambda c: f"lower({strip(c)})"
    heading = " OR ".join(
        f"(starts_with({low(c)}, '''') AND contains({low(c)}, '(')) OR regexp_matches({low(c)}, '^\\w+(date|time|amount|balance|detail)')"
        f" OR {low(c)} IN ('date', 'details', 'amount', 'balance', 'debit', 'credit', 'reference')"
        for c in _CELLS
    )
    headers = ["txndate", "transactiondate", "field", "column", "amount(", "balance(", "debit(", "credit(", "date("]
    d, money_ = strip("details"), f"({f('debit')} OR {f('credit')})"
    fx = ["^\\d+\\.\\d+\\s+GBP@$", "^\\d+\\.\\d{6,}$", "^INCL FX FEE\\s+[€E]\\d+\\.\\d+$", "^\\d+@\\s+\\d+\\.\\d+\\s+EACH$"]
    return (
        f"CASE WHEN {shapes(whole, HEADER_SHAPES)} OR {heading} THEN 'metadata'"
        f" WHEN contains({d}, 'Lending @') OR (contains({d}, 'BALANCE FORWARD') AND NOT {f('balance')}) OR (contains({d}, 'Interest Rate') AND NOT {money_}) THEN 'administrative'"
        f" WHEN regexp_matches({d}, '^IE\\d+$') THEN 'reference' WHEN regexp_matches({d}, '(?i)^Ref\\s*:\\s*\\d+') THEN 'continuation'"
        f" WHEN {shapes(d, fx)} AND NOT {money_} THEN 'continuation' WHEN regexp_matches({d}, '\\d{{2}}[A-Z]{{3}}\\d{{2,4}}\\s+TIME\\s+\\d{{2}}:\\d{{2}}') THEN 'metadata'"
        f" WHEN {money_} OR regexp_matches({d}, '^(VDC-|VDP-|VDA-|ATM|D/D)') OR ({shapes(strip('date'), DATE_SHAPES)} AND NOT {words_like('lower(date)', headers)})"
        f" OR ({f('balance')} AND {d} <> '') THEN 'transaction' ELSE 'metadata' END"
    )


T = f"{W}, g AS ({cells(True)}), t AS (SELECT *, {row_type()} AS row_type FROM g)"
ROWS = f"{T}, r AS (SELECT *, row_number() OVER (PARTITION BY file, page_no ORDER BY y_key) AS row_no FROM t WHERE row_type IN ('transaction', 'continuation'))"


def completeness() -> str:
    weights = {"date": 0.2, "details": 0.3, "debit": 0.25, "credit": 0.25, "balance": 0.2}
    parts = []
    for c, w in weights.items():
        good = f"length({strip(c)}) > 5" if c == "details" else "false" if c == "date" else f"regexp_matches({strip(c)}, '^\\d+\\.\\d{{2}}$')"
        share = 0.2 if c == "details" else 0.3
        parts.append(f"CASE WHEN {strip(c)} <> '' THEN CAST({w} AS DOUBLE) + CASE WHEN {good} THEN CAST({w} AS DOUBLE) * {share} ELSE 0 END ELSE 0 END")
    return f"round(least(1.0, ({' + '.join(parts)}) / CAST({sum(weights.values())} AS DOUBLE)), 6)"


_COVER = " + ".join(f"max(CASE WHEN {strip(c)} <> '' THEN 1 ELSE 0 END)" for c in _CELLS)
_LINES = f"n AS (SELECT file, page_no, round_even(top, 0) AS y_key, string_agg(text, ' ' ORDER BY word_seq, text) AS line, count(*) AS n_words, min(x0) AS \"left\", max(x1) AS \"right\" FROM w GROUP BY 1, 2, 3)"
_PAGE_WORDS = ["date", "trans date", "transaction date", "posting date", "value date", "details", "description", "particulars", "narrative", "amount", "debit", "dr", "withdrawal", "payments", "credit", "cr", "deposit", "lodgement", "balance", "running balance", "closing balance", "transaction", "reference", "ref", "ref no", "memo"]
_HITS = " + ".join(f"CASE WHEN contains(lower(line), '{w}') THEN 1 ELSE 0 END" for w in _PAGE_WORDS)

_GIVES = "(row_type = 'transaction' AND date <> '' AND details = '' AND debit = '' AND credit = '' AND balance = '')"
_OPEN = "(row_type = 'transaction' AND date = '')"
_SPLIT = (
    f"o AS (SELECT *, {_GIVES} AS only_date, {_OPEN} AS open_row FROM r), q AS (SELECT *, only_date AND coalesce(lead(open_row) OVER p, false) AS gives,"
    f" CASE WHEN open_row AND coalesce(lag(only_date) OVER p, false) THEN lag(date) OVER p END AS given FROM o WINDOW p AS (PARTITION BY file, page_no ORDER BY row_no)),"
    f" c AS (SELECT file, page_no, row_no, row_type, coalesce(given, date) AS date, details, debit, credit, balance FROM q WHERE NOT gives)"
)
MERGED = (
    f"{ROWS}, {_SPLIT}, h AS (SELECT *, sum(CASE WHEN row_type = 'continuation' THEN 0 ELSE 1 END) OVER (PARTITION BY file, page_no ORDER BY row_no) AS grp FROM c),"
    " m AS (SELECT file, page_no, min(row_no) AS row_no, max(row_type) FILTER (WHERE row_type <> 'continuation') AS row_type,"
    " max(date) FILTER (WHERE row_type <> 'continuation') AS date, coalesce(string_agg(details, ' ' ORDER BY row_no) FILTER (WHERE details <> ''), '') AS details,"
    " max(debit) FILTER (WHERE row_type <> 'continuation') AS debit, max(credit) FILTER (WHERE row_type <> 'continuation') AS credit,"
    " max(balance) FILTER (WHERE row_type <> 'continuation') AS own, first(balance ORDER BY row_no) FILTER (WHERE row_type = 'continuation' AND balance <> '') AS tail FROM h GROUP BY file, page_no, grp),"
    " z AS (SELECT file, page_no, row_no, row_type, date, details, debit, credit, CASE WHEN own <> '' OR tail IS NULL THEN own ELSE tail END AS balance FROM m WHERE row_type IS NOT NULL)"
)
FILLED = (
    f"{MERGED}, y AS (SELECT *, {row_type()} AS kind FROM z), e AS (SELECT *, CASE WHEN kind = 'transaction' AND date <> '' THEN date END AS own_date FROM y),"
    " p AS (SELECT *, last_value(own_date IGNORE NULLS) OVER (PARTITION BY file ORDER BY page_no, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM e)"
)

NB = f"{W}, g AS ({cells(False)}), {_LINES}, t AS (SELECT g.*, n.line, {row_type()} AS row_type FROM g JOIN n USING (file, page_no, y_key))"
_FILLED_SHARE = " + ".join(f"CASE WHEN {strip(c)} <> '' THEN 1 ELSE 0 END" for c in _CELLS)
_STRONG = ["END OF STATEMENT", "STATEMENT TOTAL", "CLOSING BALANCE", "FINAL BALANCE", "ACCOUNT TOTAL", "*** END ***", "STATEMENT CONTINUES", "CONTINUED ON NEXT PAGE"]
BOUNDARY = (
    f"{NB}, a AS (SELECT *, ({_FILLED_SHARE}) / 5.0 AS filled, CASE WHEN row_type = 'transaction' THEN 1 ELSE 0 END AS is_row FROM t WHERE y_key >= 300 OR true),"
    " b AS (SELECT *, max(CASE WHEN is_row = 1 THEN y_key END) OVER (PARTITION BY file, page_no) AS last_y, lead(y_key) OVER p AS next_y,"
    " coalesce(sum(is_row) OVER (PARTITION BY file, page_no ORDER BY y_key ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS ahead FROM a WINDOW p AS (PARTITION BY file, page_no ORDER BY y_key)),"
    " d AS (SELECT *, coalesce(y_key > last_y, false) AS aft FROM b),"
    " i AS (SELECT *, sum(CASE WHEN aft AND filled >= 0.3 THEN 1 ELSE 0 END) OVER p AS island, CASE WHEN aft AND filled < 0.3 THEN 1 ELSE 0 END AS sparse,"
    " sum(CASE WHEN aft AND is_row = 0 THEN 1 ELSE 0 END) OVER p AS quiet_run FROM d WINDOW p AS (PARTITION BY file, page_no ORDER BY y_key)),"
    " j AS (SELECT *, sum(sparse) OVER (PARTITION BY file, page_no, island ORDER BY y_key) AS sparse_run FROM i),"
    f" u AS (SELECT file, page_no, max(last_y) AS last_y, min(CASE WHEN aft AND {words_like('upper(line)', _STRONG)} THEN y_key END) AS s,"
    " min(CASE WHEN y_key >= last_y AND next_y - y_key >= 50 AND ahead = 0 THEN y_key END) AS g,"
    " min(CASE WHEN sparse = 1 AND sparse_run = 8 THEN y_key END) AS n, min(CASE WHEN aft AND is_row = 0 AND quiet_run = 15 THEN y_key END) AS q FROM j GROUP BY 1, 2)"
    " SELECT file, page_no, CASE WHEN last_y IS NULL THEN 720.0 ELSE coalesce(floor(s - 10), floor(g + 20), greatest(floor(n - 120), CASE WHEN n IS NOT NULL THEN floor(last_y + 30) END), CASE WHEN q IS NOT NULL THEN floor(last_y + 60) END, 720.0) END AS boundary,"
    " CAST(CASE WHEN last_y IS NULL THEN 0 WHEN s IS NOT NULL THEN 1 WHEN g IS NOT NULL THEN 2 WHEN n IS NOT NULL THEN 3 WHEN q IS NOT NULL THEN 4 ELSE 0 END AS INTEGER) AS phase FROM u"
)

P = f"WITH p AS ({PAGES_SQL})"
CARD_SHAPES = ["card\\s+number", "credit\\s+limit", "credit\\s+card", "\\bvisa\\b", "\\bmastercard\\b"]


def doc_type() -> str:
    card = ["\\*{4}\\s*\\*{4}\\s*\\*{4}\\s*[0-9]{4}", "card\\s*(?:number|no\\.?):\\s*\\*+\\s*[0-9]{4}"]
    loan = ["loan\\s*(?:ref|reference|no|number):\\s*[A-Z0-9-]+", "mortgage\\s*(?:account|ref|no):\\s*[A-Z0-9-]+"]
    ci = lambda ps: shapes("text", [f"(?i){p}" for p in ps])
    return (
        f"CASE WHEN {ci(card)} THEN 'credit_card_statement' WHEN {ci(loan)} THEN 'loan_statement' WHEN {ci(['iban:\\s*[A-Z]{2}[0-9]{2}'])} THEN 'bank_statement'"
        f" WHEN {words_like('lower(text)', ['credit card statement', 'card statement'])} THEN 'credit_card_statement'"
        f" WHEN {words_like('lower(text)', ['loan statement', 'mortgage statement'])} THEN 'loan_statement' END"
    )


def _has(w: str) -> str:
    return f"contains(lower(text), '{w}')"


_IBAN_AIB = "regexp_matches(text, '\\bIE[0-9]{2}AIBK[A-Z0-9]{0,26}\\b')"
_IBAN_IE = "regexp_matches(text, '\\bIE[0-9]{2}[A-Z0-9]{4,30}\\b')"
_SHARE = "((" + " + ".join(f"CASE WHEN {_has(w)} THEN 1 ELSE 0 END" for w in ("date", "details", "debit", "credit", "balance")) + ") / 5.0)"


def _template(name: str, kind: str, parts: list[tuple[str, float]], iban_: str = "false", excluded: str = "false") -> str:
    score = " + ".join(f"{e} * CAST({w} AS DOUBLE)" for e, w in parts)
    return (
        f"SELECT file, document_type, '{name}' AS template_id, '{kind}' AS template_type, round({score}, 6) AS score,"
        f" greatest({', '.join(e for e, _ in parts)}) AS best, {iban_} AS has_iban, {excluded} AS excluded FROM k"
    )


def _case(test: str, value: float) -> str:
    return f"CASE WHEN {test} THEN CAST({value} AS DOUBLE) ELSE 0.0 END"


_TWO = lambda a, b: f"CASE WHEN {_has(a)} AND {_has(b)} THEN CAST(0.75 AS DOUBLE) WHEN {_has(a)} OR {_has(b)} THEN CAST(0.7 AS DOUBLE) ELSE 0.0 END"
SCORES = f"{P}, k AS (SELECT file, text, {doc_type()} AS document_type FROM p), s AS (" + " UNION ALL ".join(
    [
        _template("default", "bank_statement", [(f"CASE WHEN {_SHARE} >= 0.9 THEN CAST(0.9 AS DOUBLE) WHEN {_SHARE} >= 0.8 THEN CAST(0.75 AS DOUBLE) WHEN {_SHARE} >= 0.7 THEN CAST(0.6 AS DOUBLE) ELSE 0.0 END", 1.5)]),
        _template(
            "bank_a",
            "bank_statement",
            [(_case(_IBAN_AIB, 1.0), 2.0), (_case("file LIKE '%\\_aib.pdf' ESCAPE '\\'", 0.8), 0.8), (_case(_has("statement of account"), 0.7), 1.0)],
            _IBAN_AIB,
            _has("draft only"),
        ),
        _template("bank_b", "bank_statement", [(_case(_IBAN_IE, 0.95), 2.0)], _IBAN_IE, _has("draft only")),
        _template("card_a", "credit_card_statement", [(_case("regexp_matches(text, '[*]{4} [*]{4} [*]{4} [0-9]{4}')", 0.95 if len("[*]{4} [*]{4} [*]{4} [0-9]{4}") > 30 else 0.9), 2.0), (_TWO("credit limit", "card statement"), 1.0)]),
        _template("loan_default", "loan_statement", [(_case("regexp_matches(text, 'LN-[0-9]+')", 0.9), 2.0), (_case(_has("mortgage"), 0.7), 1.0)]),
    ]
) + ")"

_CLEAN_IBAN = "upper(regexp_replace(iban, '[\\s\\-.]', '', 'g'))"
_LENGTH = f"CASE substr({_CLEAN_IBAN}, 1, 2) " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in LENGTHS.items()) + " END"
VALID = f"coalesce(regexp_matches({_CLEAN_IBAN}, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$') AND length({_CLEAN_IBAN}) >= 15 AND length({_CLEAN_IBAN}) = {_LENGTH}, false)"

# --- charges, layout and documents -------------------------------------------------------

C = f"WITH l AS ({CHARGES_SQL}), {valued()}"
_PLUS = "CASE WHEN amount > 0 THEN amount END"
RECURRING = f"""r AS (
    SELECT details, count(*) AS occurrences, round(avg(CAST({_PLUS} AS DOUBLE)), 2) AS average_amount, round(avg(CASE WHEN gap > 0 THEN gap END), 1) AS average_gap_days, 'monthly' AS frequency
    FROM (SELECT *, day - lag(day) OVER (PARTITION BY details ORDER BY day, ord) AS gap, avg(CAST({_PLUS} AS DOUBLE)) OVER (PARTITION BY details) AS mean FROM v WHERE details <> '')
    GROUP BY details HAVING count(*) >= 2 AND count({_PLUS}) >= 2 AND max(CASE WHEN amount > 0 THEN abs(CAST(amount AS DOUBLE) - mean) END) <= 0.05 * max(mean) AND avg(CASE WHEN gap > 0 THEN gap END) BETWEEN 25 AND 35)"""
VENDORS = f"""d AS (
    SELECT details, count(*) AS n, {even(f'sum({_PLUS})')} AS total, {_AVERAGE} AS average, CAST(min({_PLUS}) AS DOUBLE) AS lowest, CAST(max({_PLUS}) AS DOUBLE) AS highest
    FROM v WHERE details <> '' GROUP BY details HAVING count(*) >= 2 AND count({_PLUS}) > 0)"""
HIGH = "h AS (SELECT ord, date, details, CAST(amount AS DOUBLE) AS amount, round((CAST(amount AS DOUBLE) - mean_amount) / std_amount, 2) AS z_score FROM v, s WHERE amount > 0 AND std_amount > 0 AND CAST(amount AS DOUBLE) > mean_amount + 2 * std_amount)"

H = f"WITH w AS (WITH b AS ({WORDS_SQL}), edges AS (SELECT file, page_no, min(word_seq) AS s, min(top) AS lo, max(top) AS hi FROM b GROUP BY 1, 2) {HEADED_SQL})"
CLUSTERS = "k AS (SELECT file, page_no, cluster, avg(x0) AS center, count(*) AS size FROM (SELECT *, sum(cut) OVER (PARTITION BY file, page_no ORDER BY x0, word_seq) AS cluster FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY file, page_no ORDER BY x0, word_seq) > 3 THEN 1 ELSE 0 END AS cut FROM w)) GROUP BY 1, 2, 3 HAVING count(*) >= 2)"
# Words of table headers and footers.
HEADER_WORDS = ["date", "details", "description", "debit", "credit", "amount", "transaction", "reference", "particulars"]
NOT_HEADER = ["forward", "interest", "lending", "@"]
FOOTER_WORDS = ["continued", "overleaf", "page", "total", "balance brought forward", "balance carried forward", "end of statement", "thank you", "overdrawn", "for important information", "standard conditions", "regulated by", "authorised limit"]
_HEADING = " + ".join(f"CASE WHEN contains(line, '{w}') THEN 1 ELSE 0 END" for w in HEADER_WORDS)
# positions are walked downwards: each line knows the last data row above it
TABLES = f"""{H}, g AS (SELECT file, page_no, round_even(top / 5, 0) * 5 AS y, lower(string_agg(text, ' ' ORDER BY word_seq)) AS line, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM w GROUP BY 1, 2, 3),
    t AS (SELECT file, page_no, min(y) AS hy FROM g WHERE NOT {words_like('line', NOT_HEADER)} AND ({_HEADING}) >= 3 AND n BETWEEN 4 AND 10 GROUP BY 1, 2),
    r AS (SELECT g.*, hy, max(CASE WHEN n >= 3 OR y = hy THEN y END) OVER (PARTITION BY file, page_no ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM g JOIN t USING (file, page_no) WHERE y >= hy AND hy <> 0),
    f AS (SELECT file, page_no, min(y) AS fy FROM r WHERE y > hy AND ({words_like('line', FOOTER_WORDS)} OR (y - above > 100 AND n < 10)) GROUP BY 1, 2),
    p AS (SELECT r.*, fy, y - lag(y) OVER (PARTITION BY file, page_no ORDER BY y) AS step FROM r LEFT JOIN f USING (file, page_no) WHERE (n >= 3 OR y = hy) AND (fy IS NULL OR y < fy)),
    z AS (SELECT file, page_no, min(x0) AS x0, max(hy) - 5 AS y0, max(x1) AS x1, coalesce(max(fy) - 10, max(y) + CASE WHEN count(*) >= 3 THEN coalesce(1.5 * avg(CASE WHEN step < 50 THEN step END), 20) ELSE 20 END) AS y1 FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
    q AS (SELECT * FROM z WHERE y1 - y0 >= 50)"""
MONTH_MARKS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "/"]

_SEARCH = ["\\b([A-Z]{2}\\d{2}[A-Z0-9]{10,30})\\b", "\\b([A-Z]{2}\\d{2}[A-Z0-9\\s]{10,30})\\b", "\\b([A-Z]{2}\\d{2}[\\s\\-\\.]*(?:[A-Z0-9][\\s\\-\\.]*){10,30})\\b"]
_FOUND = "list_concat(list_concat({}, {}), {})".format(*[f"regexp_extract_all(text, '(?i){p}', 1)" for p in _SEARCH])
_BY_COUNTRY = " OR ".join(f"(length(x) = {n} AND substr(x, 1, 2) IN ({', '.join(repr(c) for c, own in LENGTHS.items() if own == n)}))" for n in sorted(set(LENGTHS.values())))
FIRST_IBAN = f"list_filter(list_transform({_FOUND}, lambda c: upper(regexp_replace(c, '[\\s\\-.]', '', 'g'))), lambda x: regexp_matches(x, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$') AND ({_BY_COUNTRY}))[1]"
CHECKSUM = f"list_reduce(list_prepend(0, list_transform(string_split(concat(substr({_CLEAN_IBAN}, 5), substr({_CLEAN_IBAN}, 1, 4)), ''), lambda x: CAST(CASE WHEN x BETWEEN '0' AND '9' THEN ord(x) - 48 ELSE ord(x) - 55 END AS INTEGER))), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"


def _explained(template: str, parts: list[tuple[str, str, float]], excluded: str = "") -> str:
    rows = [f"SELECT file, '{template}' AS template_id, '{name}' AS detector, {e} AS confidence, round({e} * CAST({w} AS DOUBLE), 6) AS weighted FROM p WHERE {e} > 0" for name, e, w in parts]
    if excluded:
        rows.append(f"SELECT file, '{template}', 'exclusion', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM p WHERE {excluded}")
    return " UNION ALL ".join(rows)


_COLUMN_SHARE = f"CASE WHEN {_SHARE} >= 0.9 THEN CAST(0.9 AS DOUBLE) WHEN {_SHARE} >= 0.8 THEN CAST(0.75 AS DOUBLE) WHEN {_SHARE} >= 0.7 THEN CAST(0.6 AS DOUBLE) ELSE 0.0 END"
EXPLAINED = " UNION ALL ".join(
    [
        _explained("default", [("column_header", _COLUMN_SHARE, 1.5)]),
        _explained(
            "bank_a",
            [("iban", _case(_IBAN_AIB, 1.0), 2.0), ("filename", _case("file LIKE '%\\_aib.pdf' ESCAPE '\\'", 0.8), 0.8), ("header", _case(_has("statement of account"), 0.7), 1.0)],
            _has("draft only"),
        ),
        _explained("bank_b", [("iban", _case(_IBAN_IE, 0.95), 2.0)], _has("draft only")),
        _explained("card_a", [("card_number", _case("regexp_matches(text, '[*]{4} [*]{4} [*]{4} [0-9]{4}')", 0.9), 2.0), ("header", _TWO("credit limit", "card statement"), 1.0)]),
        _explained("loan_default", [("loan_reference", _case("regexp_matches(text, 'LN-[0-9]+')", 0.9), 2.0), ("header", _case(_has("mortgage"), 0.7), 1.0)]),
    ]
)

ORACLES: dict[str, str] = {
    "expense_report": f"""{C}, {STATS}, {RECURRING}, {VENDORS}, {HIGH}
        SELECT 'statistics' AS section, CAST(NULL AS VARCHAR) AS details, mean_amount AS value, CAST(NULL AS BIGINT) AS n FROM s UNION ALL SELECT 'recurring_charges', details, average_amount, occurrences FROM r
        UNION ALL SELECT 'high_value', details, amount, NULL FROM h UNION ALL SELECT 'repeated_vendors', details, total, n FROM d""",
    "iban_checksum": f"WITH {_F} SELECT filename, {CHECKSUM} AS passes FROM f WHERE iban IS NOT NULL",
    "cluster_boundaries": f"""{W}, {CLUSTERS}, o AS (SELECT *, row_number() OVER p AS i, lead(center) OVER p AS following, min(center) OVER (PARTITION BY file, page_no) AS lo FROM k WINDOW p AS (PARTITION BY file, page_no ORDER BY center))
        SELECT file, page_no, concat('Column', CAST(i AS VARCHAR)) AS name, round(center, 6) AS x_min, round(CASE WHEN following IS NOT NULL THEN (center + following) / 2 WHEN i > 1 THEN center + (center - lo) / (i - 1) ELSE center + 100 END, 6) AS x_max FROM o""",
    "header_columns": f"""{H}, a AS (SELECT *, CASE WHEN x0 - lag(x1) OVER p > 10 THEN 1 ELSE 0 END AS cut FROM (SELECT *, min(top) OVER (PARTITION BY file, page_no) AS first FROM w) WHERE top <= first + 5 WINDOW p AS (PARTITION BY file, page_no ORDER BY x0, word_seq)),
        b AS (SELECT *, sum(cut) OVER (PARTITION BY file, page_no ORDER BY x0, word_seq) AS island FROM a),
        c AS (SELECT file, page_no, island, string_agg(text, ' ' ORDER BY word_seq) AS name, greatest(min(x0) - 5, 0) AS x_min, max(x1) + 50 AS x_max FROM b GROUP BY 1, 2, 3),
        e AS (SELECT *, lead(x_min) OVER (PARTITION BY file, page_no ORDER BY x_min, island) AS following FROM c)
        SELECT file, page_no, name, round(x_min, 6) AS x_min, round(CASE WHEN x_max > following THEN following - 1 ELSE x_max END, 6) AS x_max FROM e""",
    "text_tables": f"{TABLES} SELECT file, page_no, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM q",
    "estimated_rows": f"{TABLES} SELECT file, CAST(sum(floor((y1 - y0) / 15)) AS BIGINT) AS estimate FROM q GROUP BY 1",
    "multiline_dates": f"""{W}, a AS (SELECT file, page_no, round_even(top / 5, 0) * 5 AS y, count(*) FILTER (WHERE x0 >= 26 AND x1 <= 78) AS n, count(*) FILTER (WHERE x0 >= 26 AND x1 <= 78 AND {words_like('lower(text)', MONTH_MARKS)}) AS dated FROM w GROUP BY 1, 2, 3),
        b AS (SELECT file, page_no, count(*) FILTER (WHERE n > 0) AS total, count(*) FILTER (WHERE dated > 0) AS dated FROM a GROUP BY 1, 2) SELECT file, page_no, total >= 3 AND dated > 0 AND dated / total < 0.6 AS multiline FROM b""",
    "document_facts": f"{P} SELECT file, {shapes('text', ['(?i)' + s for s in CARD_SHAPES])} AS is_card, TRY_CAST(regexp_extract(text, '(?i)Payment\\s+Due\\s+(?:Date\\s*[:\\s]\\s*)?\\d{{1,2}}(?:st|nd|rd|th)?\\s+\\w+,?\\s+(\\d{{4}})', 1) AS INTEGER) AS statement_year, {doc_type()} AS document_type, {FIRST_IBAN} AS iban FROM p",
    "template_explain": f"{P} {EXPLAINED}",
    "iban_spatial": f"""{W}, s AS (SELECT file, page_no, min(word_seq) - 10 AS word_seq, min(x0) - 20 AS x0, min(top) - 20 AS y0, max(x1) + 20 AS x1, max(bottom) + 20 AS y1 FROM w GROUP BY 1, 2),
        n AS (SELECT file, word_seq, 'IE29AIBK93115212345678' AS iban, 60 AS a0, 295 AS a1, 50 AS b0, 58 AS b1, x0, y0, x1, y1 FROM s),
        o AS (SELECT *, CASE WHEN b0 / 842.0 <= 0.25 THEN 50 ELSE 0 END + 30 * (1 - b0 / 842.0) AS score FROM n WHERE NOT (a0 <= x1 AND x0 <= a1 AND b0 <= y1 AND y0 <= b1))
        SELECT file, iban, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, word_seq) AS i FROM o) WHERE i = 1""",
    "monthly_summary": f"""{L}, x AS (SELECT {parse_date(add_year())} AS day, {to_decimal('debit')} AS d, {to_decimal('credit')} AS c FROM l)
        SELECT CASE WHEN year(day) <= 1970 THEN 'Unknown' ELSE strftime(day, '%Y-%m') END AS month,
        {even('coalesce(sum(CASE WHEN d > 0 THEN d END), 0)')} AS debit, count(CASE WHEN d > 0 THEN 1 END) AS debit_transactions,
        {even('coalesce(sum(CASE WHEN c > 0 THEN c END), 0)')} AS credit, count(CASE WHEN c > 0 THEN 1 END) AS credit_transactions FROM x GROUP BY 1""",
    "column_totals": f"{L} SELECT CAST(coalesce(sum(CAST({to_float('debit')} AS {_DEC})), 0) AS DOUBLE) AS debit, CAST(coalesce(sum(CAST({to_float('credit')} AS {_DEC})), 0) AS DOUBLE) AS credit FROM l",
    "totals_row": f"{L} SELECT 'TOTAL' AS date, '' AS details, {money(f'coalesce(sum(CAST({to_float(DEBIT)} AS {_DEC})), 0)')} AS debit, {money(f'coalesce(sum(CAST({to_float(CREDIT)} AS {_DEC})), 0)')} AS credit, '' AS balance FROM l",
    "expense_statistics": f"{L}, {valued()}, {STATS} SELECT * FROM s",
    "high_value": f"{L}, {valued()}, {STATS}, {HIGH} SELECT * FROM h",
    "recurring_charges": f"{C}, {RECURRING} SELECT * FROM r",
    "repeated_vendors": f"{C}, {VENDORS} SELECT * FROM d",
    "similar_descriptions": f"{L} SELECT lower({strip('details')}) AS description, count(*) AS n FROM l GROUP BY 1",
    "amount_parse": f"{L} SELECT ord, {to_float('debit')} AS debit_value, {to_float('credit')} AS credit_value, CASE WHEN {to_float('balance')} >= 0 THEN {to_float('balance')} END AS balance_value FROM l",
    "decimal_amounts": f"{L} SELECT ord, CAST(CASE WHEN NOT {blank('debit')} THEN -({to_decimal('debit')}) WHEN NOT {blank('credit')} THEN {to_decimal('credit')} END AS DOUBLE) AS signed, CAST({to_decimal('balance')} AS DOUBLE) AS balance FROM l",
    "currency_format": f"{L}, x AS (SELECT ord, TRY_CAST({to_float('debit')} AS DECIMAL(18,2)) AS v FROM l) SELECT ord, coalesce(concat(CASE WHEN v < 0 THEN '-' ELSE '' END, '€', format('{{:,}}', CAST(trunc(abs(v)) AS BIGINT)), '.', lpad(CAST(CAST(round((abs(v) - trunc(abs(v))) * 100) AS BIGINT) AS VARCHAR), 2, '0')), '') AS shown FROM x WHERE v IS NOT NULL UNION ALL SELECT ord, '' FROM x WHERE v IS NULL",
    "currency_strip": f"{L} SELECT ord, {bare('debit')} AS debit, {bare('credit')} AS credit FROM l",
    "credit_reroute": f"{L}, x AS (SELECT ord, debit, credit, ends_with(upper({strip('debit')}), 'CR') AS cr FROM l) SELECT ord, CASE WHEN cr THEN '' ELSE debit END AS debit, CASE WHEN cr THEN {strip(f'''regexp_replace({strip('debit')}, '(?i)CR$', '')''')} ELSE credit END AS credit FROM x",
    "date_parse": f"{L} SELECT ord, {parse_date('date')} AS parsed FROM l",
    "date_parse_yearless": f"{L} SELECT ord, {parse_date('date', 'statement_year')} AS parsed, {add_year()} AS with_year FROM l",
    "filter_empty": f"{L} SELECT ord FROM l WHERE NOT {EMPTY}",
    "filter_header": f"{L}, {_CLEAN} SELECT ord FROM c WHERE NOT {_header()}",
    "filter_dates": f"{L} SELECT ord FROM l WHERE {DATED}",
    "filter_all": f"{L}, {_CLEAN} SELECT ord FROM c WHERE NOT {EMPTY} AND NOT {_header()} AND {DATED}",
    "canonical_projection": f"{L} SELECT date, details, debit, credit, balance, filename, CAST(ord AS VARCHAR) AS extra_ord, statement_year AS extra_year FROM l",
    "output_projection": f"{L} SELECT {add_year()} AS \"Date\", details AS \"Details\", debit AS \"Debit\", credit AS \"Credit\", balance AS \"Balance\", filename AS \"Filename\", document_type FROM l",
    "account_group": f"{L}, {_F} SELECT ord, coalesce(right(upper(replace(iban, ' ', '')), 4), 'unknown') AS account_suffix FROM l LEFT JOIN f USING (filename)",
    "card_group": f"{L}, {_F} SELECT ord, CASE WHEN card IS NULL THEN 'unknown' ELSE right(regexp_replace(card, '[^A-Za-z0-9]', '', 'g'), 4) END AS account_suffix FROM l LEFT JOIN f USING (filename)",
    "exclude_unknown": f"{L}, {_F} SELECT ord, filename FROM l JOIN f USING (filename) WHERE iban IS NULL",
    "iban_ledger": f"WITH {_F} SELECT filename, CASE WHEN length(i) > 8 THEN concat(substr(i, 1, 4), repeat('*', CAST(length(i) - 8 AS INTEGER)), right(i, 4)) ELSE i END AS masked, sha256(i) AS digest FROM (SELECT filename, {_CLEAN_IBAN} AS i FROM f WHERE iban IS NOT NULL)",
    "iban_validate": f"WITH {_F} SELECT filename, {VALID} AS valid FROM f WHERE iban IS NOT NULL",
    "iban_extract": f"WITH {_F}, x AS (SELECT filename, concat('Account ', coalesce(iban, 'none'), ', page 1') AS line, iban FROM f) SELECT filename, CASE WHEN {VALID} THEN {_CLEAN_IBAN} END AS iban FROM x",
    "classify_bank": f"{L} SELECT ord, {by_words(BANK_WORDS)} AS kind FROM l",
    "classify_card": f"{L} SELECT ord, {by_words(CARD_WORDS)} AS kind FROM l",
    "classify_amount": f"{L} SELECT ord, {by_amount()} AS kind FROM l",
    "classify_template": f"{L} SELECT ord, CASE WHEN contains(upper(details), 'URGENT') THEN 'urgent' WHEN contains(upper(details), 'MISC') THEN 'various' END AS kind FROM l",
    "classify_chain": f"{L}, t AS ({typed()}) SELECT ord, transaction_type FROM t",
    "dedup_all_fields": f"{_D}, t AS (SELECT * FROM l), {_marked(KEY_ALL)} SELECT ord, is_duplicate FROM m",
    "dedup_date_amount": f"{_D}, t AS (SELECT * FROM l), {_marked(KEY_SUM)} SELECT ord, is_duplicate FROM m",
    "dedup_card": f"{_D}, t AS ({typed()}), {_marked(KEY_CARD)} SELECT ord, is_duplicate FROM m",
    "dedup_by_account": f"{_D}, {_F}, t AS (SELECT l.*, coalesce(right(upper(replace(iban, ' ', '')), 4), 'unknown') AS account FROM l LEFT JOIN f USING (filename)), {_marked(KEY_ALL, ', account')} SELECT ord, is_duplicate FROM m",
    "dedup_statistics": f"{_D}, t AS (SELECT * FROM l), {_marked(KEY_ALL)} SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_duplicate) AS unique_rows, count(*) FILTER (WHERE is_duplicate) AS duplicates, round(count(*) FILTER (WHERE is_duplicate) * 100.0 / count(*), 2) AS duplicate_rate FROM m",
    "chronological_order": f"{L} SELECT ord, row_number() OVER (PARTITION BY filename ORDER BY {parse_date('date', 'statement_year')}, ord) AS position FROM l",
    "run_summary": f"{_D}, t AS (SELECT * FROM l), {_marked(KEY_ALL)}, {_F} SELECT (SELECT count(*) FROM f) AS file_count, count(DISTINCT filename) AS files_extracted, count(*) FILTER (WHERE NOT is_duplicate) AS transactions, count(*) FILTER (WHERE is_duplicate) AS duplicates, (SELECT CAST(sum(pages) AS BIGINT) FROM f) AS pages_read FROM m",
    "lines_by_y": f"{W}, {_LINES} SELECT * FROM n",
    "words_to_columns": f"{W} {cells(True)}",
    "words_to_columns_loose": f"{W} {cells(False)}",
    "column_coverage": f"{W}, g AS ({cells(True)}) SELECT file, page_no, ({_COVER}) / CAST(5 AS DOUBLE) AS coverage FROM g GROUP BY 1, 2",
    "row_types": f"{T} SELECT file, page_no, y_key, row_type FROM t",
    "row_completeness": f"{T} SELECT file, page_no, y_key, {completeness()} AS score, {shapes(strip('date'), DATE_SHAPES)} AS dated FROM t",
    "page_validate": f"{T} SELECT file, page_no, count(*) AS n_rows, round(({_COVER}) / 5.0, 6) AS coverage, round(avg(CASE WHEN row_type = 'transaction' THEN 1.0 ELSE 0.0 END), 6) AS ratio, ({_COVER}) / 5.0 >= 0.2 AND avg(CASE WHEN row_type = 'transaction' THEN 1.0 ELSE 0.0 END) >= 0.1 AS valid FROM t GROUP BY 1, 2",
    "header_detect": f"{W}, {_LINES}, h AS (SELECT *, row_number() OVER (PARTITION BY file, page_no ORDER BY y_key) AS rank FROM n) SELECT file, page_no, max({_HITS}) AS header_words, max({_HITS}) >= 2 AS has_header FROM h WHERE rank <= 5 GROUP BY 1, 2",
    "merge_rows": f"{MERGED} SELECT * FROM z",
    "date_fill": f"{FILLED} SELECT file, page_no, row_no, CASE WHEN kind = 'transaction' AND own_date IS NULL AND filled IS NOT NULL THEN filled ELSE date END AS date, CASE WHEN kind = 'transaction' THEN round(1.0 - CASE WHEN own_date IS NULL AND filled IS NOT NULL THEN 0.1 ELSE 0 END - CASE WHEN {strip('balance')} = '' THEN 0.2 ELSE 0 END, 6) END AS confidence_score FROM p",
    "boundaries": BOUNDARY,
    "content_density": f"{NB}, s AS (SELECT *, count(*) OVER (PARTITION BY file, page_no) AS n, row_number() OVER p AS place, count(*) OVER q AS filled, sum(CASE WHEN row_type = 'transaction' THEN 1 ELSE 0 END) OVER q AS hits, list(y_key) OVER q AS ys FROM t WINDOW p AS (PARTITION BY file, page_no ORDER BY y_key), q AS (PARTITION BY file, page_no ORDER BY y_key ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT file, page_no, ys[CAST(floor(least(5, n) / 2) AS INTEGER) + 1] AS y, round(hits / CAST(filled AS DOUBLE), 6) AS density FROM s WHERE n >= 2 AND place + least(5, n) - 1 <= n",
    "x_clusters": f"{W}, a AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY file, page_no ORDER BY x0, word_seq) > 3 THEN 1 ELSE 0 END AS cut FROM w), b AS (SELECT *, sum(cut) OVER (PARTITION BY file, page_no ORDER BY x0, word_seq) AS cluster FROM a) SELECT file, page_no, cluster, round(avg(x0), 6) AS center, count(*) AS size FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 2",
    "crop_region": f"{W} SELECT file, page_no, word_seq FROM w WHERE bottom > 350 AND top < 500 AND x1 > 100 AND x0 < 300",
    "bbox_overlap": f"{W}, b AS (SELECT file, page_no, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1 FROM w GROUP BY 1, 2) SELECT file, page_no, least(x1, 400) >= greatest(x0, 200) AND least(y1, 450) >= greatest(y0, 350) AS touches, round(CASE WHEN least(x1, 400) >= greatest(x0, 200) AND least(y1, 450) >= greatest(y0, 350) THEN (least(x1, 400) - greatest(x0, 200)) * (least(y1, 450) - greatest(y0, 350)) / least((x1 - x0) * (y1 - y0), 20000) ELSE 0 END, 6) AS ratio FROM b",
    "card_detect": f"{P} SELECT file, {shapes('text', ['(?i)' + s for s in CARD_SHAPES])} AS is_card FROM p",
    "statement_year": f"{P} SELECT file, TRY_CAST(regexp_extract(text, '(?i)Payment\\s+Due\\s+(?:Date\\s*[:\\s]\\s*)?\\d{{1,2}}(?:st|nd|rd|th)?\\s+\\w+,?\\s+(\\d{{4}})', 1) AS INTEGER) AS statement_year FROM p",
    "document_types": f"{P} SELECT file, {doc_type()} AS document_type FROM p",
    "card_numbers": "SELECT doc_id, len(regexp_extract_all(text, '\\b\\d{4}[ -]?\\d{4}[ -]?\\d{4}[ -]?\\d{4}\\b')) AS n_cards, nullif(regexp_extract(text, '\\b\\d{4}[ -]?\\d{4}[ -]?\\d{4}[ -]?\\d{4}\\b'), '') AS first_card FROM documents",
    "template_scores": f"{SCORES} SELECT * FROM s",
    "template_select": f"""{SCORES}, u AS (SELECT *, (document_type IS NULL OR template_type = document_type) AND NOT excluded AND score > 0 AS usable FROM s),
        t AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN usable THEN 0 ELSE 1 END, score DESC, has_iban DESC, best DESC, template_id) AS n FROM u)
        SELECT file, document_type, CASE WHEN usable AND score >= 0.6 THEN template_id WHEN document_type = 'credit_card_statement' THEN 'card_a' WHEN document_type = 'loan_statement' THEN 'loan_default' WHEN document_type = 'bank_statement' THEN 'default' ELSE 'default' END AS template_id,
        CASE WHEN usable AND score >= 0.6 THEN score ELSE 0.0 END AS score FROM t WHERE n = 1""",
}
