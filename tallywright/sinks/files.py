"""Writers of results. Large results stay distributed; a group's file is small."""

from __future__ import annotations

import json
import os
import re
import secrets
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.config import Entitlements, OutputError, canonical_format
from tallywright.functions import amounts
from tallywright.operators import reports

# Parts of names of columns that a sheet shows as numbers.
NUMERIC = ("debit", "credit", "balance", "amount", "total", "price", "cost", "fee", "charge", "€", "$", "£", "¥")


def write_accounts(df: DataFrame, folder: str, format: str = "parquet") -> None:
    """All groups at once, a folder for each account."""
    df.write.mode("overwrite").partitionBy("account_suffix").format(format).save(folder)


def write_reports(df: DataFrame, folder: str) -> None:
    """Months, recurring charges and repeated vendors of all accounts at once, a folder for each account."""
    by = ("account_suffix",)
    for name, made in (("monthly_summary", reports.monthly_summary), ("recurring_charges", reports.recurring_charges), ("repeated_vendors", reports.repeated_vendors)):
        made(df, by=by).write.mode("overwrite").partitionBy(*by).json(f"{folder}/{name}")


def numeric_projection(df: DataFrame) -> DataFrame:
    """Cells of money columns as numbers where they are numbers."""
    is_money = lambda n: any(p in n.lower() for p in NUMERIC)
    return df.select(*[amounts.to_float(F.col(f"`{c}`")).alias(c) if is_money(c) else F.col(f"`{c}`") for c in df.columns])


def write_csv(df: DataFrame, path: str, columns=schema.OUTPUT_COLUMNS, totals: DataFrame | None = None) -> None:
    """One file of one group; totals stand behind a blank line, in quotes."""
    df.select(*columns).toPandas().to_csv(path, index=False, encoding="utf-8")
    if totals is not None:
        row = totals.first()
        with open(path, "a", encoding="utf-8") as out:
            out.write("\n" + ",".join(f'"{row[c] if c in row else ""}"' for c in columns) + "\n")


def write_json(df: DataFrame, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump([r.asDict(recursive=True) for r in df.toLocalIterator()], out, indent=2, ensure_ascii=False, default=str)


def write_excel(df: DataFrame, path: str, columns=schema.OUTPUT_COLUMNS, totals: DataFrame | None = None) -> None:
    """Sheet ``Transactions``; needs the optional library."""
    try:
        import openpyxl
    except ImportError as e:
        raise OutputError("Excel output needs openpyxl") from e
    book = openpyxl.Workbook()
    sheet = book.active
    sheet.title = "Transactions"
    sheet.append(list(columns))
    for r in numeric_projection(df.select(*columns)).toLocalIterator():
        sheet.append(list(r))
    for cells in sheet.iter_rows(min_row=2):
        for cell in cells:
            if isinstance(cell.value, float):
                cell.number_format = "#,##0.00"
    if totals is not None:
        row = totals.first()
        place = sheet.max_row + 2
        for k, c in enumerate(columns, 1):
            sheet.cell(row=place, column=k, value=row[c] if c in row else "")
    book.save(path)


WRITERS: dict[str, Callable] = {"csv": write_csv, "json": lambda df, path, **_: write_json(df, path), "excel": write_excel}
ENDINGS = {"csv": "csv", "json": "json", "excel": "xlsx"}


def writer(name: str, entitlements: Entitlements | None = None) -> Callable:
    name = canonical_format(name)
    if name not in WRITERS:
        raise ValueError(f"unknown output format {name}")
    (entitlements or Entitlements()).check_format(name)
    return WRITERS[name]


def write_group(df: DataFrame, duplicates: DataFrame, suffix: str, folder: str, formats=("csv",), monthly: bool = True, expenses: bool = True, entitlements: Entitlements | None = None, totals: tuple[str, ...] = ()) -> dict[str, str]:
    """Files of one account: rows in each format, with totals where it has a place for them, duplicates always, reports where there are rows."""
    os.makedirs(folder, exist_ok=True)
    paths: dict[str, str] = {}
    shown = df.select(*[c for c in df.columns])
    for name in formats:
        kind = canonical_format(name)
        paths[kind] = f"{folder}/bank_statements_{suffix}.{ENDINGS[kind]}"
        columns = schema.OUTPUT_COLUMNS
        summed = reports.totals_row(reports.column_totals(shown.select(*columns), totals), columns) if totals else None
        writer(kind, entitlements)(shown, paths[kind], totals=summed)
    paths["duplicates"] = f"{folder}/duplicates_{suffix}.json"
    write_json(duplicates, paths["duplicates"])
    if not df.isEmpty():
        lower = df.withColumnsRenamed({c: c.lower() for c in df.columns})
        lower = lower if "statement_year" in lower.columns else lower.withColumn("statement_year", F.lit(None).cast("string"))
        if monthly:
            paths["monthly"] = f"{folder}/monthly_summary_{suffix}.json"
            write_json(reports.monthly_summary(lower).orderBy("month"), paths["monthly"])
        if expenses:
            paths["expenses"] = f"{folder}/expense_analysis_{suffix}.json"
            placed = lower.withColumn("ord", F.monotonically_increasing_id())
            try:
                write_json(reports.expense_report(placed).orderBy("section", F.get_json_object("entry", "$.total").cast("double").desc()), paths["expenses"])
            except Exception as e:  # a report that fails must not cost the account its files
                Path(paths["expenses"]).write_text(json.dumps({"error": str(e).splitlines()[0]}), encoding="utf-8")
                return paths
            paths["expense_transactions"] = f"{folder}/expense_transactions_{suffix}.json"
            listed = reports.expense_transactions(placed).orderBy("section", "details", "day", "ord")
            write_json(listed.select("section", "details", "date", "amount"), paths["expense_transactions"])
    return paths


def append_log(folder: str, event: str, **details) -> None:
    """One line of the activity log: processing, deletion or encryption."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/processing_activity.jsonl", "a", encoding="utf-8") as out:
        out.write(json.dumps({"timestamp": datetime.now(timezone.utc).isoformat(), "event": event, **details}) + "\n")


def append_excluded(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(f"{folder}/excluded_files")


def _outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Output files of the top level; tables and reports in folders of their own are not among them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,json,xlsx}").option("recursiveFileLookup", True).load(folder)
    own = folder.split(":", 1)[-1].rstrip("/").lstrip("/")
    return found.select("path", "length", "modificationTime").where(F.regexp_extract("path", "^(?:[a-z0-9]+:)?/*(.*)/[^/]*$", 1).endswith(own))


def expired(spark: SparkSession, folder: str, days: int, now: datetime | None = None) -> DataFrame:
    """Output files of the top level that are older than so many days; none for zero."""
    cutoff = (now or datetime.now(timezone.utc)) - timedelta(days=days)
    return _outputs(spark, folder).where(F.lit(days > 0) & (F.col("modificationTime") < F.lit(cutoff)))


def modified_between(spark: SparkSession, folder: str, start: datetime, end: datetime) -> DataFrame:
    return _outputs(spark, folder).where(F.col("modificationTime").between(F.lit(start), F.lit(end)))


def delete_files(selected: DataFrame, logs: str, reason: str, passes: int = 3) -> int:
    """Overwrites and removes the selected local files, with a log line for each."""
    n = 0
    for row in selected.select("path").toLocalIterator():
        path = Path(re.sub(r"^file:/*", "/", row[0]))
        size = path.stat().st_size
        with open(path, "r+b") as out:
            for _ in range(passes):
                out.seek(0)
                out.write(secrets.token_bytes(size))
                out.flush()
                os.fsync(out.fileno())
        path.unlink()
        append_log(logs, "deletion", path=str(path), reason=reason)
        n += 1
    return n
