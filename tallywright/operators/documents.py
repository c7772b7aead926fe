"""Facts about whole documents, and the match of documents with templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.functions import iban, text

# Shapes of card statements, due dates, and document types.
CARD_SHAPES = [r"card\s+number", r"credit\s+limit", r"credit\s+card", r"\bvisa\b", r"\bmastercard\b"]
DUE_SHAPES = [
    r"(?i)Payment\s+Due\s+Date\s*[:\s]\s*\d{1,2}(?:st|nd|rd|th)?\s+\w+,?\s+(\d{4})",
    r"(?i)Payment\s+Due\s+\d{1,2}(?:st|nd|rd|th)?\s+\w+,?\s+(\d{4})",
]
CARD_TYPE = [r"\*{4}\s*\*{4}\s*\*{4}\s*[0-9]{4}", r"card\s*(?:number|no\.?):\s*\*+\s*[0-9]{4}"]
LOAN_TYPE = [r"loan\s*(?:ref|reference|no|number):\s*[A-Z0-9-]+", r"mortgage\s*(?:account|ref|no):\s*[A-Z0-9-]+"]
BANK_TYPE = [r"iban:\s*[A-Z]{2}[0-9]{2}"]
CARD_TITLES = ["credit card statement", "card statement"]
LOAN_TITLES = ["loan statement", "mortgage statement"]
# Weights of detectors and the least score of a match.
DETECTOR_WEIGHTS = {"iban": 2.0, "card_number": 2.0, "loan_reference": 2.0, "column_header": 1.5, "header": 1.0, "filename": 0.8, "exclusion": 0.0}
THRESHOLD = 0.6
IBAN_LIKE = r"\b([A-Z]{2}[0-9]{2}[A-Z0-9]{4,30})\b"


def is_card_statement(header: Column) -> Column:
    return text.matches_any(header, CARD_SHAPES, ignore_case=True)


def statement_year(header: Column) -> Column:
    found = F.coalesce(*[F.when(F.regexp_extract(header, p, 1) != "", F.regexp_extract(header, p, 1)) for p in DUE_SHAPES])
    return found.try_cast("int")


def first_match(value: Column, patterns: Sequence[str], group: int = 0) -> Column:
    return F.coalesce(*[F.when(F.regexp_extract(value, p, group) != "", F.regexp_extract(value, p, group)) for p in patterns], F.lit(None))


def document_type(header: Column) -> Column:
    low = F.lower(header)
    return (
        F.when(text.matches_any(header, CARD_TYPE, True), "credit_card_statement")
        .when(text.matches_any(header, LOAN_TYPE, True), "loan_statement")
        .when(text.matches_any(header, BANK_TYPE, True), "bank_statement")
        .when(text.contains_any(low, CARD_TITLES), "credit_card_statement")
        .when(text.contains_any(low, LOAN_TITLES), "loan_statement")
    )


# How far down a first page bank names, column headers and account numbers, and signs of a document's type stand.
BANDS = {"text250": 250, "text350": 350, "text400": 400}


def first_pages(words: DataFrame) -> DataFrame:
    """(file, page_no, text, text250, text350, text400): the first page's text, and that of its upper parts, from one aggregate."""
    from tallywright.operators.layout import ordered_text

    parts = [ordered_text(F.col("top") < y).alias(name) for name, y in BANDS.items()]
    return words.where("page_no = 1").groupBy("file", "page_no").agg(ordered_text().alias("text"), *parts)


def band(pages: DataFrame, name: str) -> Column:
    """The text of an upper part of a page; the whole text where the frame has no such part or it is empty."""
    return F.coalesce(F.when(F.col(name) != "", F.col(name)), F.col("text")) if name in pages.columns else F.col("text")


def document_facts(pages: DataFrame, card_patterns: Sequence[str] = CARD_TYPE[:1]) -> DataFrame:
    """Card test, year, type, account number and card number of each document's first page."""
    head = band(pages, "text400")
    return pages.where("page_no = 1").select(
        "file",
        is_card_statement(head).alias("is_card"),
        statement_year(head).alias("statement_year"),
        document_type(head).alias("document_type"),
        iban.find_iban(band(pages, "text350")).alias("iban"),
        first_match(head, list(card_patterns)).alias("card"),
    )


def excluded_documents(facts: DataFrame, counts: DataFrame, require_iban: bool) -> DataFrame:
    """Documents with pages but neither account number nor rows, with the reason."""
    reason = F.lit("no IBAN and no transactions found" if require_iban else "no transactions found")
    return facts.join(counts, "file", "left").where(F.col("iban").isNull() & (F.coalesce("n_rows", F.lit(0)) == 0)).select("file", reason.alias("reason"))


def skip_cards(facts: DataFrame, require_iban: bool) -> DataFrame:
    """Without the right to cards, card statements yield nothing but a warning."""
    return facts.withColumn("warning", F.when(F.col("is_card") & F.lit(require_iban), "CREDIT_CARD_SKIPPED"))


# --- templates -------------------------------------------------------------------------


def detectors(template: Mapping, pages: DataFrame) -> dict[str, Column]:
    """Confidence of each detector that has something to look for; null where it finds nothing.

    Bank names count in the upper 250 points of a page, column headers in the upper 350, where the frame tells them apart.

    Templates are few, so their patterns are folded into expressions: matching
    every document with every template is one scan, without a join.
    """
    d = template.get("detection", {})
    name, page = F.col("file"), F.col("text")
    low = F.lower(band(pages, "text250"))
    found: dict[str, Column] = {}

    def best(patterns, make, confidence):
        return F.coalesce(*[F.when(make(p), confidence(p)) for p in sorted(patterns, key=confidence, reverse=True)])

    if d.get("iban_patterns"):
        tokens = F.regexp_extract_all(page, F.lit(IBAN_LIKE), F.lit(1))
        found["iban"] = best(
            d["iban_patterns"], lambda p: F.exists(tokens, lambda t: t.rlike(f"^(?:{p})")), lambda p: 1.0 if len(p) > 10 else 0.95
        )
    ids = d.get("document_identifiers", {})
    if ids.get("card_number_patterns"):
        found["card_number"] = best(ids["card_number_patterns"], lambda p: page.rlike(p), lambda p: 0.95 if len(p) > 30 else 0.90)
    if ids.get("loan_reference_patterns"):
        found["loan_reference"] = best(ids["loan_reference_patterns"], lambda p: page.rlike(p), lambda p: 0.95 if len(p) > 20 else 0.90)
    if d.get("filename_patterns"):
        globs = d["filename_patterns"]
        hit = F.lit(False)
        for g in globs:
            hit = hit | name.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else text.java_quote(c) for c in g) + "$")
        found["filename"] = F.when(hit, 0.90 if len(globs) > 1 else 0.80)
    if d.get("header_keywords"):
        hits = sum((F.when(F.contains(low, F.lit(w.lower())), 1).otherwise(0) for w in d["header_keywords"]), F.lit(0))
        found["header"] = F.when(hits >= 2, 0.75).when(hits == 1, 0.70)
    if d.get("column_headers"):
        upper = F.lower(band(pages, "text350"))
        hits = sum((F.when(F.contains(upper, F.lit(w.lower())), 1).otherwise(0) for w in d["column_headers"]), F.lit(0))
        share = hits / len(d["column_headers"])
        found["column_header"] = F.when(share >= 0.9, 0.90).when(share >= 0.8, 0.75).when(share >= 0.7, 0.60)
    return found


def is_excluded(template: Mapping) -> Column:
    words = template.get("detection", {}).get("exclude_keywords", [])
    return text.contains_any(F.lower("text"), [w.lower() for w in words])


def template_scores(pages: DataFrame, templates: Sequence[Mapping], weights: Mapping[str, float] = DETECTOR_WEIGHTS, extra: Mapping | None = None) -> DataFrame:
    """(file, template_id, score, best, has_iban, excluded) of every document and enabled template.

    ``extra`` maps detector names to functions from a template to a confidence
    column, for detectors of one's own.
    """
    entries = []
    for t in templates:
        if not t.get("enabled", True):
            continue
        found = detectors(t, pages) | {n: f(t) for n, f in (extra or {}).items()}
        value = lambda c: F.coalesce(c, F.lit(0.0))
        score = sum((value(c) * weights.get(n, 1.0) for n, c in found.items()), F.lit(0.0))
        best = F.greatest(F.lit(0.0), *[value(c) for c in found.values()], F.lit(0.0))
        entries.append(
            F.struct(
                F.lit(t["id"]).alias("template_id"),
                F.lit(t.get("document_type", "bank_statement")).alias("template_type"),
                score.alias("score"),
                best.alias("best"),
                (found["iban"].isNotNull() if "iban" in found else F.lit(False)).alias("has_iban"),
                is_excluded(t).alias("excluded"),
            )
        )
    typed = pages.where("page_no = 1").withColumn("document_type", document_type(band(pages, "text400")))
    return typed.select("file", "document_type", F.explode(F.array(*entries)).alias("e")).select("file", "document_type", "e.*")


def default_template(templates: Sequence[Mapping], kind: str | None) -> str:
    """The type's default, else the first enabled of the type, else the global default."""
    enabled = [t for t in templates if t.get("enabled", True)]
    ids = {t["id"] for t in enabled}
    if kind:
        own = kind.removesuffix("_statement") + "_default"
        if own in ids:
            return own
        same = [t["id"] for t in enabled if t.get("document_type", "bank_statement") == kind]
        if same:
            return same[0]
    return "default" if "default" in ids else enabled[0]["id"]


def template_explanation(pages: DataFrame, templates: Sequence[Mapping], weights: Mapping[str, float] = DETECTOR_WEIGHTS) -> DataFrame:
    """(file, template_id, detector, confidence, weighted): why a template scored as it did; exclusions show as 0."""
    entries = []
    for t in templates:
        if not t.get("enabled", True):
            continue
        found = detectors(t, pages) | {"exclusion": F.when(is_excluded(t), 0.0)}
        for name, confidence in found.items():
            entries.append(
                F.struct(
                    F.lit(t["id"]).alias("template_id"),
                    F.lit(name).alias("detector"),
                    confidence.cast("double").alias("confidence"),
                    (confidence * weights.get(name, 1.0)).cast("double").alias("weighted"),
                )
            )
    every = pages.where("page_no = 1").select("file", F.explode(F.array(*entries)).alias("e")).select("file", "e.*")
    return every.where("confidence is not null")


def select_template(scores: DataFrame, templates: Sequence[Mapping], threshold: float = THRESHOLD) -> DataFrame:
    """(file, template_id, score): the best template of the document's type, or the type's default.

    Candidates are of the document's type, or all where no template has it.
    Ties: one found by account number, then the surest detector, then the id.
    """
    kinds = {t.get("document_type", "bank_statement") for t in templates if t.get("enabled", True)}
    fits = F.col("document_type").isNull() | (F.col("template_type") == F.col("document_type")) | ~F.col("document_type").isin(*kinds)
    usable = fits & ~F.col("excluded") & (F.col("score") > 0)
    rank = F.struct(F.col("score"), F.col("has_iban"), F.col("best"))
    order = Window.partitionBy("file").orderBy(F.when(usable, 0).otherwise(1), F.desc("rank"), "template_id")
    top = scores.withColumns({"rank": rank, "usable": usable}).withColumn("n", F.row_number().over(order)).where("n = 1")
    default = F.lit(default_template(templates, None))
    for kind in sorted(kinds):
        default = F.when(F.col("document_type") == kind, default_template(templates, kind)).otherwise(default)
    good = F.col("usable") & (F.col("score") >= threshold)
    return top.select("file", "document_type", F.when(good, F.col("template_id")).otherwise(default).alias("template_id"), F.when(good, F.col("score")).otherwise(0.0).alias("score"))


def template_problems(template: Mapping) -> list[str]:
    """Sanity of a template's columns: overlaps, narrow ones, ones off the page, wide gaps, no date."""
    ranges = sorted(template.get("extraction", {}).get("columns", {}).items(), key=lambda c: c[1][0])
    said = [] if any("date" in n.lower() for n, _ in ranges) else ["no date column"]
    for n, (lo, hi) in ranges:
        said += [f"{n} is narrow"] * (hi - lo < 10) + [f"{n} is off the page"] * (hi > 600)
    for (a, (_, end)), (b, (start, _)) in zip(ranges, ranges[1:]):
        said += [f"{a} and {b} overlap"] * (start < end) + [f"gap between {a} and {b}"] * (start - end > 50)
    return said


def templates_frame(spark: SparkSession, templates: Sequence[Mapping]) -> DataFrame:
    rows = [(t["id"], t.get("name", t["id"]), t.get("enabled", True), t.get("document_type", "bank_statement")) for t in templates]
    return spark.createDataFrame(rows, "template_id string, name string, enabled boolean, document_type string")
