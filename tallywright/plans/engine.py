"""The whole run: words to rows to accounts to reports, as one chain of transforms."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.config import Config, ConfigurationError
from tallywright.functions import iban
from tallywright.operators import documents, layout, reports, rows
from tallywright.operators import transactions as txn
from tallywright.sinks import files as sink
from tallywright.sources.templates import usable as usable_templates

KEYS = {"all_fields": txn.key_all_fields, "date_amount": txn.key_date_amount, "credit_card": txn.key_card}


def duplicate_key(name: str) -> Column:
    if name not in KEYS:
        raise ConfigurationError(f"unknown duplicate strategy {name}")
    return KEYS[name]()


def within_bounds(words: DataFrame, top, bottom) -> DataFrame:
    return words.where((F.col("top") >= top) & (F.col("top") <= bottom))


def extract(words: DataFrame, config: Config | None = None, template: Mapping | None = None) -> DataFrame:
    """Rows of statements from positioned words: bounds, rows, valid pages, merging and forward fill."""
    config = config or Config()
    layout_of = (template or {}).get("extraction", {})
    least, most = layout_of.get("table_top_y", config.table_top), layout_of.get("table_bottom_y", config.table_bottom)
    top, bottom, header_top = layout.page_bounds(layout_of.get("per_page_overrides", {}), least, most, layout_of.get("header_check_top_y"))
    columns = {k: tuple(v) for k, v in (layout_of.get("columns") or config.columns).items()}
    if config.dynamic_boundary:
        area = within_bounds(words, top, bottom + 100)
        ends = layout.clamp_boundary(layout.boundaries(layout.typed_lines(area, columns, least), most), most)
        table = area.join(ends.select("file", "page_no", "boundary"), ["file", "page_no"]).where(F.col("top") <= F.col("boundary"))
    else:
        table = within_bounds(words, top, bottom)
    if layout_of.get("enable_header_check"):
        head = words.where((F.col("top") < top) & (F.col("top") >= header_top))
        table = table.join(rows.detect_headers(head).where("has_header"), ["file", "page_no"], "left_semi")
    built = layout.build_rows(table, columns)
    valid = rows.valid_pages_only(built) if layout_of.get("enable_page_validation", True) else built
    merged = rows.merge_continuations(valid)
    aliased = rows.rename_aliases(merged, (template or {}).get("column_aliases", {}))
    done = rows.post_process(aliased)
    kind = (template or {}).get("document_type", "bank_statement")
    return done.withColumns({"filename": F.element_at(F.split("file", "/"), -1), "document_type": F.lit(kind), "template_id": F.lit((template or {}).get("id")).cast("string"), "source_page": F.col("page_no")})


def extract_matched(words: DataFrame, pages: DataFrame, templates: Sequence[Mapping], config: Config | None = None) -> DataFrame:
    """Each document under the template that fits it; templates are few, documents many."""
    chosen = documents.select_template(documents.template_scores(pages, templates), templates)
    out = None
    for t in templates:
        mine = words.join(chosen.where(F.col("template_id") == t["id"]).select("file"), "file", "left_semi")
        part = extract(mine, config, t)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def process(rows_in: DataFrame, files: DataFrame, config: Config | None = None) -> DataFrame:
    """Filtered rows with account, type, duplicate mark and parsed date; sort by account, date and order to list them."""
    config = config or Config()
    kept = txn.filter_all(rows_in)
    done = txn.process_accounts(kept, files, duplicate_key(config.duplicate_strategy))
    return done.orderBy("account_suffix", "parsed_date", "ord") if config.sort_by_date else done


def iban_ledger(files: DataFrame) -> DataFrame:
    """Masked numbers and digests; never the number itself."""
    return files.where("iban is not null").select("filename", iban.mask_iban(F.col("iban")).alias("masked"), F.sha2("iban", 256).alias("digest"))


def analyze(words: DataFrame, height: float = 842.0, pages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Layout analysis: tables, account numbers outside them, columns inside them, multi-line dates and an estimate.

    Where ``pages`` are given, a page without a number among its words is searched as a text.
    """
    tables = layout.text_tables(words)
    largest = layout.largest_table(tables)
    numbers = layout.iban_candidates(words)
    if pages is not None:
        numbers = layout.candidates_or_text(numbers, pages, 595.0, height)
    outside = layout.outside_tables(numbers, layout.expand_tables(largest))
    bounds = largest.select("file", "page_no", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = words.join(bounds, ["file", "page_no"]).where("top >= _y0 and bottom <= _y1 and x0 >= _x0 and x1 <= _x1").drop("_x0", "_y0", "_x1", "_y1")
    return {
        "tables": largest,
        "ibans": layout.best_candidate(layout.score_candidates(outside, height)),
        "header_columns": layout.header_columns(inside),
        "cluster_columns": layout.cluster_boundaries(layout.x_clusters(inside)),
        "multiline": layout.multiline_dates(inside),
        "estimate": layout.estimated_rows(tables),
    }


def synthesise_template(found: Mapping[str, DataFrame], name: str) -> dict:
    """A template from the first table of an analysis: columns of its header, or of clusters where it has less than two; the default layout without a table."""
    table = found["tables"].orderBy("file", "page_no").first()
    if table is None:
        return minimal_template(name)
    here = (F.col("file") == table["file"]) & (F.col("page_no") == table["page_no"])
    columns = [found[kind].where(here).orderBy("x_min").collect() for kind in ("header_columns", "cluster_columns")]
    chosen = columns[0] if len(columns[0]) >= 2 else columns[1]
    number = found["ibans"].where(F.col("file") == table["file"]).first()
    return make_template(name, number["iban"][:2] if number else None, {r["name"]: (r["x_min"], r["x_max"]) for r in chosen}, table["y0"], table["y1"])


def make_template(name: str, country: str | None, columns: Mapping[str, tuple], top: float, bottom: float) -> dict:
    """A template from an analysis, edges rounded."""
    return {
        "id": name.lower().replace(" ", "_"),
        "name": name,
        "enabled": True,
        "document_type": "bank_statement",
        "detection": {"iban_patterns": [f"^{country}\\d{{2}}.*"] if country else []},
        "extraction": {
            "table_top_y": round(top),
            "table_bottom_y": round(bottom),
            "columns": {n: [round(lo, 1), round(hi, 1)] for n, (lo, hi) in columns.items()},
        },
    }


def save_template(template: Mapping, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(template, out, indent=2, ensure_ascii=False)


def minimal_template(name: str) -> dict:
    """What is left where an analysis finds no columns: the default layout."""
    config = Config()
    return make_template(name, None, config.columns, config.table_top, config.table_bottom)


def validate_template(words: DataFrame, template: Mapping) -> DataFrame:
    """Rows that a template extracts from first pages, by type: a trial before it is used."""
    return extract(words.where("page_no = 1"), None, template).groupBy("file", "row_type").count()


class Engine:
    """A run over stored words: templates, extraction, accounts, files, log and retention."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()

    def run(self, words: DataFrame, pages: DataFrame | None = None, template: Mapping | None = None, templates: Sequence[Mapping] | None = None) -> dict:
        """Extracts under the given template, or the one of ``templates`` that fits each document, and writes all results."""
        config, folder = self.config, self.config.output_dir
        need_iban = config.entitlements.require_iban
        pages = documents.first_pages(words) if pages is None else pages
        facts = documents.skip_cards(documents.document_facts(pages), need_iban)
        usable = usable_templates(templates, need_iban) if templates else None
        found = extract_matched(words, pages, usable, config) if usable else extract(words, config, template)
        read = found.join(facts.where("warning is null").select("file", F.col("statement_year").cast("string").alias("statement_year")), "file")
        # file, page and row together name a row: no two rows tie
        placed = read.withColumn("ord", F.struct("file", "page_no", "row_no"))
        counts = placed.groupBy("file").agg(F.count("*").alias("n_rows"))
        sink.append_excluded(documents.excluded_documents(facts, counts, need_iban), config.logs_dir)
        read_pages = words.groupBy("file").agg(F.count_distinct("page_no").alias("pages"))
        files = facts.join(read_pages, "file").select(F.element_at(F.split("file", "/"), -1).alias("filename"), "iban", "card", "pages")
        sink.write_json(iban_ledger(files).orderBy("filename"), f"{folder}/ibans.json")
        done = process(placed, files, config)
        sink.write_accounts(done, f"{folder}/accounts")
        stored = self.spark.read.parquet(f"{folder}/accounts")
        summary = reports.run_summary(stored, files).first().asDict()
        known = {t["id"]: t for t in usable or ([template] if template else [])}
        # of each account, the template of its first row
        accounts = stored.groupBy("account_suffix").agg(F.min_by("template_id", "ord").alias("template_id"))
        sink.write_reports(stored.where("not is_duplicate"), f"{folder}/reports")
        written = {}
        for row in accounts.orderBy("account_suffix").limit(config.account_files).toLocalIterator():
            own = stored.where(F.col("account_suffix") == row[0])
            words_of = known.get(row[1], {}).get("transaction_types")
            own = txn.classify_types(own, None, template_words=words_of) if words_of else own
            unique = txn.output_rows(own.where("not is_duplicate").orderBy("parsed_date", "ord"))
            repeated = txn.output_rows(txn.duplicates_for_output(own))
            written[row[0]] = sink.write_group(
                unique, repeated, row[0], folder, config.formats, config.monthly_summary, config.expense_analysis, config.entitlements, config.totals
            )
        sink.append_log(config.logs_dir, "processing", **summary)
        if config.cleanup_on_exit and config.retention_days > 0:
            summary["deleted"] = sink.delete_files(sink.expired(self.spark, folder, config.retention_days), config.logs_dir, "retention")
        return summary | {"written": written}
