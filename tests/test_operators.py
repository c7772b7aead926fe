"""Operators against small models in Python, and end to end."""

import random

import pytest
from pyspark.sql import functions as F

from tallywright.config import Config, ConfigurationError, Entitlements, EntitlementError
from tallywright.operators import documents, layout, rows
from tallywright.operators import transactions as txn
from tallywright.plans import engine
from tallywright.sinks import files as sink
from tallywright.sources import templates

ROW = "file string, page_no int, row_no int, row_type string, date string, details string, debit string, credit string, balance string"
WORD = "file string, page_no int, word_seq long, text string, x0 double, x1 double, top double, bottom double"


def types_of(spark, *cells):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, date string, details string, debit string, credit string, balance string")
    return [r[0] for r in df.orderBy("i").select(rows.row_type()).collect()]


def test_row_types(spark):
    assert types_of(
        spark,
        ("01/01/23", "Payment", "10.00", "", ""),
        ("'TxnDate'(date)", "x", "1.00", "", ""),
        ("", "BALANCE FORWARD", "", "", ""),
        ("", "0.828571", "", "", ""),
        ("", "FX RATE: 1.2345", "", "", ""),
        ("", "Ref: 123456", "", "", ""),
        ("", "IE123", "", "", ""),
        ("", "BALANCE FORWARD", "", "", "10.00"),
        ("", "", "", "", "10.00"),
    ) == ["transaction", "metadata", "administrative", "continuation", "metadata", "continuation", "reference", "transaction", "metadata"]


def test_equal_priorities_are_refused(spark):
    with pytest.raises(ValueError):
        rows.row_type([(0, "a", F.lit(True)), (0, "b", F.lit(True))])


def test_merging_carries_dates_and_balances(spark):
    table = [
        ("f", 1, 1, "continuation", "", "orphan", "", "", ""),
        ("f", 1, 2, "transaction", "01/01/23", "", "", "", ""),
        ("f", 1, 3, "transaction", "", "Shop", "5.00", "", ""),
        ("f", 1, 4, "continuation", "", "Ref: 1", "", "", ""),
        ("f", 1, 5, "continuation", "", "more", "", "", "9.00"),
        ("f", 1, 6, "transaction", "02/01/23", "Bus", "2.00", "", "7.00"),
    ]
    out = rows.merge_continuations(spark.createDataFrame(table, ROW)).orderBy("row_no").collect()
    assert [(r.date, r.details, r.balance) for r in out] == [("01/01/23", "Shop Ref: 1 more", "9.00"), ("02/01/23", "Bus", "7.00")]


def test_dates_fill_forward_over_pages(spark):
    table = [("s_20240105.pdf", 1, 1, "", "", "a", "1.00", "", "1.00"), ("s_20240105.pdf", 1, 2, "", "07/01/24", "b", "1.00CR", "", ""), ("s_20240105.pdf", 2, 1, "", "", "c", "1.00", "", "1.00")]
    out = rows.post_process(spark.createDataFrame(table, ROW)).orderBy("page_no", "row_no").collect()
    assert [r.date for r in out] == ["05 Jan 2024", "07/01/24", "07/01/24"]
    assert [round(r.confidence_score, 2) for r in out] == [0.9, 0.8, 0.9]
    assert out[1].debit == "" and out[1].credit == "1.00"
    assert [w.code for w in out[1].extraction_warnings] == ["MISSING_BALANCE"]


@pytest.mark.parametrize("seed", range(4))
def test_duplicates_by_model(spark, seed):
    rng = random.Random(seed)
    data = [(i, rng.choice(["a", "b", "c"]), rng.choice(["01/01/23", "02/01/23"]), "x", rng.choice(["1.00", "€1.00", "2.00"]), "", "") for i in range(60)]
    owner, want = {}, {}
    for i, name, date, _, debit, _, _ in data:
        key = (date, float(debit.strip("€")))
        want[i] = owner.setdefault(key, name) != name
    rng.shuffle(data)
    df = spark.createDataFrame(data, "ord int, filename string, date string, details string, debit string, credit string, balance string").repartition(5)
    got = {r.ord: r.is_duplicate for r in txn.mark_duplicates(df, txn.key_all_fields()).collect()}
    assert got == want


def words_of(*lines, page=1, file="f.pdf", first=0):
    out = []
    for top, cells in lines:
        for x, text in cells:
            out.append((file, page, first + len(out), text, float(x), float(x + 30), float(top), float(top + 8)))
    return out


def test_column_edges(spark):
    df = spark.createDataFrame(words_of((310, [(525.6, "9.99"), (30, "01/01/23")])), WORD)
    got = layout.words_to_columns(df, {"Date": (26, 78), "Balance": (525, 600)}).first()
    assert got.balance == "9.99" and got.date == "01/01/23"
    assert layout.words_to_columns(df, {"Date": (26, 78), "Balance": (525, 540)}).first().balance == ""
    assert layout.words_to_columns(df, {"Date": (26, 78), "Balance": (525, 540)}, strict_rightmost=False).first().balance == "9.99"


def statement(file="f.pdf"):
    lines = [(310 + 12 * k, [(30, f"0{k + 1}/01/23"), (80, f"Shop{k}"), (260, f"{k + 1}.00"), (380, "50.00")]) for k in range(5)]
    return words_of(*lines, (600, [(80, "END"), (110, "OF"), (130, "STATEMENT")]), file=file)


def test_strong_end_bounds_the_table(spark):
    df = spark.createDataFrame(statement(), WORD)
    assert layout.boundaries(layout.typed_lines(df)).first()[2:] == (590.0, 1)


def test_table_and_columns_from_headers(spark):
    head = (290, [(30, "Date"), (80, "Details"), (260, "Debit"), (320, "Credit"), (380, "Balance")])
    df = spark.createDataFrame(words_of(head, first=-100) + statement(), WORD)
    table = layout.text_tables(df).first()
    assert (table.y0, table.y1) == (285.0, 590.0)  # five points over the header line
    names = [r.name for r in layout.header_columns(df).orderBy("x_min").collect()]
    assert names == ["Date", "Details", "Debit", "Credit", "Balance"]


def test_iban_outside_tables(spark):
    number = [(60 + 40 * k, t) for k, t in enumerate(("IE29", "AIBK", "9311", "5212", "3456", "78"))]
    df = spark.createDataFrame(words_of((50, number), first=-100) + statement(), WORD)
    found = layout.iban_candidates(df)
    assert [r.iban for r in found.collect()] == ["IE29AIBK93115212345678"]
    table = spark.createDataFrame([("f.pdf", 1, 0.0, 40.0, 500.0, 60.0)], "file string, page_no int, x0 double, y0 double, x1 double, y1 double")
    assert layout.outside_tables(found, table).count() == 0


def test_template_choice(spark):
    pages = spark.createDataFrame([("a_aib.pdf", 1, "IBAN: IE29AIBK93115212345678"), ("x.pdf", 1, "nothing")], "file string, page_no int, text string")
    chosen = {r.file: r.template_id for r in documents.select_template(documents.template_scores(pages, templates.SAMPLES), templates.SAMPLES).collect()}
    assert chosen == {"a_aib.pdf": "bank_a", "x.pdf": "default"}


def test_template_files(tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "extraction": {"columns": {"Date": [1, 2]}}}')
    (tmp_path / "b.json").write_text("{broken")
    assert [t["id"] for t in templates.load_folders([tmp_path])] == ["a"]
    with pytest.raises(ValueError):
        templates.parse_template({"id": "x", "extraction": {"columns": {"Date": [1]}}})
    assert documents.template_problems({"extraction": {"columns": {"A": (0, 5), "B": (4, 700)}}}) == ["no date column", "A is narrow", "B is off the page", "A and B overlap"]


def test_engine_end_to_end(spark, tmp_path):
    words = spark.createDataFrame(statement("f.pdf") + statement("g.pdf"), WORD)
    pages = spark.createDataFrame([("f.pdf", 1, "IBAN: IE29AIBK93115212345678"), ("g.pdf", 1, "IBAN: IE29AIBK93115212345678")], "file string, page_no int, text string")
    config = Config(output_dir=str(tmp_path / "out"), logs_dir=str(tmp_path / "logs"), formats=("csv", "json"))
    done = engine.Engine(spark, config).run(words, pages)
    assert (done["file_count"], done["files_extracted"], done["pages_read"], done["transactions"], done["duplicates"]) == (2, 2, 2, 5, 5)
    lines = (tmp_path / "out" / "bank_statements_5678.csv").read_text().splitlines()
    assert len(lines) == 8 and lines[6] == "" and lines[7].startswith('"TOTAL","","15.00"')
    assert (tmp_path / "logs" / "processing_activity.jsonl").exists()


def test_run_with_templates_cards_and_exclusions(spark, tmp_path):
    """Two templates with columns of their own, a card statement that the tier skips, a document without anything."""
    iban = lambda n: (50, [(30, "IBAN:"), (70, n)])
    shifted = [(410 + 12 * k, [(30, f"1{k}/02/23"), (80, f"Other{k}"), (300, f"{k + 1}.50")]) for k in range(3)]
    early = [(320, [(30, "01/01/23"), (80, "TooHigh"), (300, "9.99")])]
    words = (
        words_of(iban("IE29AIBK93115212345678"), first=-50, file="a.pdf") + statement("a.pdf")
        + words_of(iban("IE64BOFI90583812345678"), *early, *shifted, file="b.pdf")
        + words_of((40, [(30, "Credit"), (70, "Limit")]), *shifted, file="card.pdf")
        + words_of((40, [(30, "Dear"), (70, "customer")]), file="empty.pdf")
    )
    columns = {"Date": [26, 78], "Details": [78, 255], "Debit": [255, 313], "Credit": [313, 369], "Balance": [369, 434]}
    moved = columns | {"Debit": [295, 313], "Details": [78, 295]}
    chosen = [
        templates.parse_template({"id": "aib", "detection": {"iban_patterns": ["IE[0-9]{2}AIBK.*"]}, "extraction": {"table_top_y": 300, "table_bottom_y": 590, "columns": columns}}),
        templates.parse_template({"id": "bofi", "detection": {"iban_patterns": ["IE[0-9]{2}BOFI.*"]}, "extraction": {"table_top_y": 300, "table_bottom_y": 720, "columns": moved, "per_page_overrides": {"1": {"table_top_y": 400}}}}),
    ]
    config = Config(output_dir=str(tmp_path / "out"), logs_dir=str(tmp_path / "logs"), cleanup_on_exit=True, retention_days=30)
    done = engine.Engine(spark, config).run(spark.createDataFrame(words, WORD), templates=chosen)
    assert (done["file_count"], done["files_extracted"], done["pages_read"], done["transactions"]) == (4, 2, 4, 8)
    assert done["deleted"] == 0
    stored = spark.read.parquet(str(tmp_path / "out" / "accounts"))
    assert {(r.filename, r.template_id) for r in stored.select("filename", "template_id").distinct().collect()} == {("a.pdf", "aib"), ("b.pdf", "bofi")}
    assert sorted(r.debit for r in stored.where("filename = 'b.pdf'").collect()) == ["1.50", "2.50", "3.50"]
    excluded = spark.read.json(str(tmp_path / "logs" / "excluded_files"))
    assert {r.file for r in excluded.collect()} == {"card.pdf", "empty.pdf"}
    masked = (tmp_path / "out" / "ibans.json").read_text()
    assert "IE29" in masked and "93115212" not in masked
    months = spark.read.json(str(tmp_path / "out" / "reports" / "monthly_summary"))
    assert {(r.account_suffix, r.month, r.debit_transactions) for r in months.collect()} == {(5678, "2023-01", 5), (5678, "2023-02", 3)}


def test_analysis_makes_a_template(spark, tmp_path):
    head = (290, [(30, "Date"), (80, "Details"), (260, "Debit"), (320, "Credit"), (380, "Balance")])
    number = (50, [(30, "IBAN:"), (70, "IE29AIBK93115212345678")])
    df = spark.createDataFrame(words_of(number, head, first=-100) + statement(), WORD)
    made = engine.synthesise_template(engine.analyze(df, pages=documents.first_pages(df)), "My Bank")
    assert made["id"] == "my_bank" and made["detection"]["iban_patterns"] == ["^IE\\d{2}.*"]
    assert list(made["extraction"]["columns"]) == ["Date", "Details", "Debit", "Credit", "Balance"]
    assert (made["extraction"]["table_top_y"], made["extraction"]["table_bottom_y"]) == (285, 590)
    assert templates.parse_template(made)["id"] == "my_bank"
    assert engine.synthesise_template(engine.analyze(df.limit(0)), "None")["extraction"]["columns"]


def test_files_are_found_and_decoded(spark, tmp_path):
    from tallywright.sources import files

    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("b.pdf", "a.pdf", "sub/c.pdf", "note.txt"):
        (tmp_path / "in" / name).write_text(name)

    def decode(path, content):
        if content == b"b.pdf":
            raise ValueError("broken")
        return iter([{"file": path, "page_no": 1, "word_seq": 0, "text": content.decode(), "x0": 1.0, "x1": 2.0, "top": 3.0, "bottom": 4.0}])

    folder = str(tmp_path / "in")
    assert [r.filename for r in files.discover(spark, folder).orderBy("file_ord").collect()] == ["a.pdf", "b.pdf", "c.pdf"]
    assert files.discover(spark, folder, recursive=False).count() == 2
    rows = files.read_words(spark, folder, decode=decode).collect()
    assert sorted(r.text for r in rows if r.error is None) == ["a.pdf", "sub/c.pdf"]
    assert [r.error for r in rows if r.error] == ["ValueError: broken"]
    assert files.read_json(spark, str(tmp_path / "none.json")).count() == 0


def test_retention(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    assert sink.expired(spark, str(tmp_path), 0).count() == 0
    import os

    os.utime(tmp_path / "a.csv", (0, 0))
    assert sink.delete_files(sink.expired(spark, str(tmp_path), 30), str(tmp_path / "logs"), "Data retention policy") == 1
    assert not (tmp_path / "a.csv").exists()


def test_config():
    assert Config.from_env({"TABLE_TOP_Y": "10", "OUTPUT_FORMATS": "csv, xlsx"}).formats == ("csv", "xlsx")
    with pytest.raises(ConfigurationError):
        Config.from_env({"TABLE_TOP_Y": "x"})
    with pytest.raises(ConfigurationError):
        Config(table_top=800)
    with pytest.raises(EntitlementError):
        sink.writer("json", Entitlements(formats=("csv",)))


def test_streams(spark, tmp_path):
    from tallywright.streaming import ledger_stream as stream

    fields = "ord long, filename string, date string, details string, debit string, credit string, balance string, statement_year string"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", "01/01/2024", "x", "5.00", "", "", None), (2, "b", "01/01/2024", "x", "5.00", "", "", None)], fields).write.parquet(source)
    sink_of = stream.deduplicating_sink(str(tmp_path / "owners"), str(tmp_path / "out"), txn.key_all_fields)

    def drain():
        query = stream.read_ledger(spark, source, fields).writeStream.foreachBatch(sink_of).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()

    drain()
    spark.createDataFrame([(3, "c", "01/01/2024", "x", "5.00", "", "", None)], fields).write.mode("append").parquet(source)
    drain()
    got = {r.ord: r.is_duplicate for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: False, 2: True, 3: True}
    query = stream.monthly_stream(stream.read_ledger(spark, source, fields)).writeStream.outputMode("complete").format("memory").queryName("months").start()
    query.processAllAvailable()
    assert spark.table("months").first()["debit"] == 15.0
    query.stop()


def test_warnings_as_json(spark):
    from tallywright.functions import text

    df = spark.createDataFrame([('[{"code":"A","message":"m","page":2}, "odd"]',), (None,)], "j string")
    got = [[tuple(w) for w in r[0]] for r in df.select(text.warnings_from_json(F.col("j"))).collect()]
    assert got == [[("A", "m", 2), ("UNKNOWN", "odd", None)], []]


def test_number_of_the_text_where_words_have_none(spark):
    empty = layout.iban_candidates(spark.createDataFrame(statement(), WORD))
    pages = spark.createDataFrame([("f.pdf", 1, "IBAN IE29AIBK93115212345678")], "file string, page_no int, text string")
    row = layout.candidates_or_text(empty, pages, 600, 840).first()
    assert (row.iban, row.y1) == ("IE29AIBK93115212345678", 280.0)


def test_explanation_and_trial(spark):
    pages = spark.createDataFrame([("a_aib.pdf", 1, "IBAN: IE29AIBK93115212345678 draft only")], "file string, page_no int, text string")
    said = {(r.template_id, r.detector): r.confidence for r in documents.template_explanation(pages, templates.SAMPLES).collect()}
    assert said[("bank_a", "iban")] == 1.0 and said[("bank_a", "exclusion")] == 0.0 and said[("bank_a", "filename")] == 0.8
    words = spark.createDataFrame(statement(), WORD)
    assert engine.validate_template(words, engine.minimal_template("Any")).first()["count"] == 5


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [1.0, 2.0, 10.0, 11.0], [5.0] * 9, [1.0, 1.0, 1.0, 100.0, 1e9], []])
def test_exact_median(spark, values):
    import statistics

    from tallywright.operators import reports

    df = spark.createDataFrame([(v,) for v in values], "amount double")
    for cells in (4096, 2):
        assert reports.exact_median(df, "amount", cells).first()[0] == (statistics.median(values) if values else None)


def test_transactions_of_vendors_are_written(spark, tmp_path):
    import json

    rows = [("01/03/2024", "Gym", "30.00"), ("01/01/2024", "Gym", "30.00"), ("31/01/2024", "Gym", "30.00"), ("05/01/2024", "Shop", "9.50"), ("02/01/2024", "Shop", None), ("03/01/2024", "Once", "1.00")]
    df = spark.createDataFrame([(d, n, a, None, "2024") for d, n, a in rows], "date string, details string, debit string, credit string, statement_year string").coalesce(1)
    paths = sink.write_group(df, df.limit(0), "0001", str(tmp_path), formats=("json",), monthly=False)
    got = [(r["section"], r["details"], r["date"], r["amount"]) for r in json.load(open(paths["expense_transactions"], encoding="utf-8"))]
    gym = [("Gym", d, 30.0) for d in ("01/01/2024", "31/01/2024", "01/03/2024")]
    shop = [("Shop", "02/01/2024", 0.0), ("Shop", "05/01/2024", 9.5)]
    assert got == [("recurring_charges", *r) for r in gym] + [("repeated_vendors", *r) for r in gym + shop]
