"""Geometry: from positioned words to lines, columns, tables and bounds.

Words have file, page_no, word_seq, text, x0, x1, top and bottom. Everything
is grouped by file and page, which are small; no page is special.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.functions import bbox, iban, text
from tallywright.operators import rows

PAGE = ("file", "page_no")
# Table limits and detector settings.
TABLE_TOP, TABLE_BOTTOM = 300, 720
MIN_GAP, BREAKDOWN, CONSECUTIVE, DENSITY_WINDOW = 50, 8, 15, 5
# Texts that end a statement.
STRONG_ENDS = [
    "END OF STATEMENT",
    "STATEMENT TOTAL",
    "CLOSING BALANCE",
    "FINAL BALANCE",
    "ACCOUNT TOTAL",
    "*** END ***",
    "STATEMENT CONTINUES",
    "CONTINUED ON NEXT PAGE",
]
# Signs of a date in a date column.
DATE_MARKS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "/"]
# Words of table headers and footers.
HEADER_WORDS = ["date", "details", "description", "debit", "credit", "amount", "transaction", "reference", "particulars"]
NOT_HEADER = ["forward", "interest", "lending", "@"]
FOOTER_WORDS = [
    "continued",
    "overleaf",
    "page",
    "total",
    "balance brought forward",
    "balance carried forward",
    "end of statement",
    "thank you",
    "overdrawn",
    "for important information",
    "standard conditions",
    "regulated by",
    "authorised limit",
]


def ordered_text(keep: Column | None = None) -> Column:
    """Aggregate: the texts of a group in word order, joined by spaces."""
    word = F.struct("word_seq", "text")
    listed = F.array_sort(F.collect_list(word if keep is None else F.when(keep, word)))
    return text.strip(F.array_join(F.transform(listed, lambda w: w["text"]), " "))


def lines_by_y(words: DataFrame) -> DataFrame:
    """Lines of words of equal rounded top (ties to even), with their text and extent."""
    return words.groupBy(*PAGE, F.rint("top").alias("y_key")).agg(
        ordered_text().alias("line"), F.count("*").alias("n_words"), F.min("x0").alias("left"), F.max("x1").alias("right")
    )


def column_of(columns: Mapping[str, tuple], strict_rightmost: bool = True) -> Column:
    """The first column that holds a word's left edge; null words are dropped. Folded into one CASE, no join."""
    names = list(columns)
    chosen = None
    for k, name in enumerate(names):
        lo, hi = columns[name]
        last = strict_rightmost and k == len(names) - 1
        inside = (F.col("x0") >= lo) & (F.coalesce(F.col("x1"), F.col("x0") + F.greatest(F.length("text") * 3, F.lit(10))) <= hi if last else F.col("x0") < hi)
        chosen = F.when(inside, name) if chosen is None else chosen.when(inside, name)
    return chosen


def words_to_columns(words: DataFrame, columns: Mapping[str, tuple] = schema.DEFAULT_COLUMNS, strict_rightmost: bool = True) -> DataFrame:
    """One row a line; a cell is the text of its words, or empty."""
    placed = words.withColumn("_column", column_of(columns, strict_rightmost))
    cells = [ordered_text(F.col("_column") == n).alias(n.lower()) for n in columns]
    return placed.groupBy(*PAGE, F.rint("top").alias("y_key")).agg(*cells)


def column_coverage(table: DataFrame, names=("date", "details", "debit", "credit", "balance")) -> DataFrame:
    """Share of columns that are filled anywhere on the page."""
    filled = [F.max(F.when(~text.is_blank(F.col(n)), 1).otherwise(0)) for n in names]
    return table.groupBy(*PAGE).agg((sum(filled, F.lit(0)) / len(names)).alias("coverage"))


def build_rows(words: DataFrame, columns: Mapping[str, tuple] = schema.DEFAULT_COLUMNS) -> DataFrame:
    """Typed rows of transactions and continuations, numbered by page."""
    typed = words_to_columns(words, columns).withColumn("row_type", rows.row_type())
    kept = typed.where(F.col("row_type").isin("transaction", "continuation"))
    return kept.withColumn("row_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y_key")))


def page_bounds(overrides: Mapping[int, Mapping], top=TABLE_TOP, bottom=TABLE_BOTTOM, header_top=None) -> tuple[Column, Column, Column]:
    """(top, bottom, header's top) of a word's page, field by field from the page's override or the template. Pages with overrides are few: one CASE each."""

    def of(field: str, default) -> Column:
        chosen = F.lit(None).cast("double")
        for page, own in overrides.items():
            if own.get(field) is not None:
                chosen = F.when(F.col("page_no") == page, float(own[field])).otherwise(chosen)
        return F.coalesce(chosen, F.lit(default).cast("double"))

    upper = of("table_top_y", top)
    return upper, of("table_bottom_y", bottom), F.coalesce(of("header_check_top_y", header_top), F.greatest(upper - 50, F.lit(0.0)))


def crop(words: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return words.where((F.col("bottom") > y0) & (F.col("top") < y1) & (F.col("x1") > x0) & (F.col("x0") < x1))


def cells_and_line(words: DataFrame, columns: Mapping[str, tuple], strict_rightmost: bool = True) -> DataFrame:
    """Cells of a line and its whole text, from one aggregate."""
    placed = words.withColumn("_column", column_of(columns, strict_rightmost))
    cells = [ordered_text(F.col("_column") == n).alias(n.lower()) for n in columns]
    return placed.groupBy(*PAGE, F.rint("top").alias("y_key")).agg(*cells, ordered_text().alias("line"))


def typed_lines(words: DataFrame, columns: Mapping[str, tuple] = schema.DEFAULT_COLUMNS, top: float = TABLE_TOP) -> DataFrame:
    """Lines below the table's top with cells, type and share of filled cells."""
    names = [n.lower() for n in columns]
    placed = cells_and_line(words.where(F.col("top") >= top), columns, strict_rightmost=False)
    filled = sum((F.when(~text.is_blank(F.col(n)), 1).otherwise(0) for n in names), F.lit(0))
    return placed.withColumns({"row_type": rows.row_type(), "filled": filled / len(names)})


def boundaries(lines: DataFrame, fallback: float = TABLE_BOTTOM) -> DataFrame:
    """Where the table ends on each page, by four phases in order; pages without transactions get the fallback."""
    page = Window.partitionBy(*PAGE)
    down = page.orderBy("y_key")
    is_row = F.when(F.col("row_type") == "transaction", 1).otherwise(0)
    y = F.col("y_key")
    marked = lines.withColumns({"is_row": is_row}).withColumns(
        {
            "last_y": F.max(F.when(F.col("is_row") == 1, y)).over(page),
            "next_y": F.lead("y_key").over(down),
            "rows_ahead": F.coalesce(F.sum("is_row").over(down.rowsBetween(1, DENSITY_WINDOW)), F.lit(0)),
        }
    )
    after = marked.withColumn("after", F.col("y_key") > F.col("last_y"))
    blank = text.is_blank(F.col("line"))
    sparse = F.col("after") & ~blank & (F.col("filled") < 0.3)
    reset = F.when(F.col("after") & ~blank & (F.col("filled") >= 0.3), 1).otherwise(0)
    runs = after.withColumns(
        {"sparse": F.when(sparse, 1).otherwise(0), "island": F.sum(reset).over(down), "quiet": F.when(F.col("after") & (F.col("is_row") == 0), 1).otherwise(0)}
    ).withColumns(
        {
            "sparse_run": F.sum("sparse").over(Window.partitionBy(*PAGE, "island").orderBy("y_key")),
            "quiet_run": F.sum("quiet").over(down),
        }
    )
    strong = F.col("after") & text.contains_any(F.upper("line"), STRONG_ENDS)
    gap = (y >= F.col("last_y")) & (F.col("next_y") - y >= MIN_GAP) & (F.col("rows_ahead") == 0)
    thin = (F.col("sparse") == 1) & (F.col("sparse_run") == BREAKDOWN)
    quiet = (F.col("quiet") == 1) & (F.col("quiet_run") == CONSECUTIVE)
    first = runs.groupBy(*PAGE).agg(
        F.max("last_y").alias("last_y"),
        F.min(F.when(strong, y)).alias("strong_y"),
        F.min(F.when(gap, y)).alias("gap_y"),
        F.min(F.when(thin, y)).alias("thin_y"),
        F.min(F.when(quiet, y)).alias("quiet_y"),
    )
    whole = lambda c: F.floor(c).cast("double")
    found = F.coalesce(
        whole(F.col("strong_y") - 10),
        whole(F.col("gap_y") + 20),
        F.when(F.col("thin_y").isNotNull(), F.greatest(whole(F.col("thin_y") - BREAKDOWN * 15), whole(F.col("last_y") + 30))),
        F.when(F.col("quiet_y").isNotNull(), whole(F.col("last_y") + 60)),
    )
    phase = (
        F.when(F.col("strong_y").isNotNull(), 1).when(F.col("gap_y").isNotNull(), 2).when(F.col("thin_y").isNotNull(), 3).when(F.col("quiet_y").isNotNull(), 4).otherwise(0)
    )
    known = F.col("last_y").isNotNull()
    return first.select(
        *PAGE,
        F.when(known, F.coalesce(found, F.lit(float(fallback)))).otherwise(float(fallback)).alias("boundary"),
        F.when(known, phase).otherwise(0).cast("int").alias("phase"),
    )


def clamp_boundary(found: DataFrame, bottom: float = TABLE_BOTTOM) -> DataFrame:
    """A detected end never passes the static bottom."""
    return found.withColumn("boundary", F.least("boundary", F.lit(float(bottom))))


def content_density(lines: DataFrame, window: int = DENSITY_WINDOW) -> DataFrame:
    """Share of transactions among filled lines in each window of lines; pages of less than two lines have none."""
    page = Window.partitionBy(*PAGE)
    down = page.orderBy("y_key")
    sized = lines.withColumns({"n": F.count("*").over(page), "at": F.row_number().over(down)}).where("n >= 2")
    span = F.least(F.lit(window), F.col("n"))
    ahead = down.rowsBetween(0, window - 1)
    filled = F.sum(F.when(~text.is_blank(F.col("line")), 1).otherwise(0)).over(ahead)
    hits = F.sum(F.when(F.col("row_type") == "transaction", 1).otherwise(0)).over(ahead)
    middle = F.element_at(F.collect_list("y_key").over(ahead), F.floor(span / 2).cast("int") + 1)
    return (
        sized.withColumns({"filled_lines": filled, "hits": hits, "y": middle})
        .where(F.col("at") + span - 1 <= F.col("n"))
        .select(*PAGE, "y", F.when(F.col("filled_lines") > 0, F.col("hits") / F.col("filled_lines")).otherwise(0.0).alias("density"))
    )


def x_clusters(words: DataFrame, tolerance: float = 3.0, least: int = 2) -> DataFrame:
    """Left edges of a page cut where they lie more than the tolerance apart; small clusters go."""
    by_x = Window.partitionBy(*PAGE).orderBy("x0", "word_seq")
    cut = F.when(F.col("x0") - F.lag("x0").over(by_x) > tolerance, 1).otherwise(0)
    numbered = words.withColumn("cut", cut).withColumn("cluster", F.sum("cut").over(by_x))
    return (
        numbered.groupBy(*PAGE, "cluster")
        .agg(F.avg("x0").alias("center"), F.count("*").alias("size"))
        .where(F.col("size") >= least)
    )


def cluster_boundaries(clusters: DataFrame) -> DataFrame:
    """Column ranges: each ends midway to the next, the last one the mean distance of centres on, or 100 if it is the only one."""
    page = Window.partitionBy(*PAGE)
    across = page.orderBy("center")
    following, rank = F.lead("center").over(across), F.row_number().over(across)
    distance = F.when(rank > 1, (F.col("center") - F.min("center").over(page)) / (rank - 1)).otherwise(100.0)
    return clusters.select(
        *PAGE,
        F.concat(F.lit("Column"), rank).alias("name"),
        F.col("center").alias("x_min"),
        F.coalesce((F.col("center") + following) / 2, F.col("center") + distance).alias("x_max"),
    )


def header_words(words: DataFrame, tolerance: float = 5.0) -> DataFrame:
    return words.withColumn("_top", F.min("top").over(Window.partitionBy(*PAGE))).where(F.col("top") <= F.col("_top") + tolerance).drop("_top")


def header_columns(words: DataFrame, gap: float = 10, left: float = 5, right: float = 50) -> DataFrame:
    """Columns from the words of the header row; near words are one name, overlapping ranges are cut."""
    by_x = Window.partitionBy(*PAGE).orderBy("x0", "word_seq")
    top = header_words(words)
    cut = F.when(F.col("x0") - F.lag("x1").over(by_x) > gap, 1).otherwise(0)
    named = top.withColumn("cut", cut).withColumn("island", F.sum("cut").over(by_x))
    ranges = named.groupBy(*PAGE, "island").agg(
        ordered_text().alias("name"), F.greatest(F.min("x0") - left, F.lit(0.0)).alias("x_min"), (F.max("x1") + right).alias("x_max")
    )
    following = F.lead("x_min").over(Window.partitionBy(*PAGE).orderBy("x_min", "island"))
    return ranges.withColumn("x_max", F.when(F.col("x_max") > following, following - 1).otherwise(F.col("x_max"))).select(*PAGE, "name", "x_min", "x_max")


def nearest_columns(clusters: DataFrame, columns: Mapping[str, tuple], within: float = 100) -> DataFrame:
    """The declared column whose centre is nearest to a cluster's, if near enough."""
    choices = F.array(*[F.struct(F.abs(F.col("center") - (lo + hi) / 2).alias("d"), F.lit(n).alias("name")) for n, (lo, hi) in columns.items()])
    best = F.array_min(choices)
    return clusters.withColumn("name", F.when(best["d"] < within, best["name"]))


def text_rows(words: DataFrame) -> DataFrame:
    """Lines in steps of five points."""
    return words.groupBy(*PAGE, (F.rint(F.col("top") / 5) * 5).alias("y")).agg(
        F.lower(ordered_text()).alias("line"), F.count("*").alias("n_words"), F.min("x0").alias("x0"), F.max("x1").alias("x1")
    )


def is_table_header(line: Column, n_words: Column) -> Column:
    hits = sum((F.when(F.contains(line, F.lit(w)), 1).otherwise(0) for w in HEADER_WORDS), F.lit(0))
    return (hits >= 3) & n_words.between(4, 10) & ~text.contains_any(line, NOT_HEADER)


def text_tables(words: DataFrame, least: float = 50) -> DataFrame:
    """The table of a page from its header line to its footer, if it has a data row and is high enough.

    Data rows have three words or more. A footer is the first line below the
    header with a footer word, or of less than ten words far below the last
    data row; it ends the table, so the rows before it are all data rows or
    none of the table's.
    """
    page = Window.partitionBy(*PAGE)
    down = page.orderBy("y")
    lines = text_rows(words).withColumn("header_y", F.min(F.when(is_table_header(F.col("line"), F.col("n_words")), F.col("y"))).over(page))
    body = lines.where((F.col("header_y") != 0) & (F.col("y") >= F.col("header_y")))
    below = F.col("y") > F.col("header_y")
    is_row = (F.col("n_words") >= 3) | ~below
    last = F.last(F.when(is_row, F.col("y")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    ends = below & (text.contains_any(F.col("line"), FOOTER_WORDS) | ((F.col("y") - last > 100) & (F.col("n_words") < 10)))
    footed = body.withColumns({"is_row": is_row, "ends": ends}).withColumn("footer_y", F.min(F.when(F.col("ends"), F.col("y"))).over(page))
    kept = footed.where(F.col("is_row") & (F.col("footer_y").isNull() | (F.col("y") < F.col("footer_y")))).withColumn("step", F.col("y") - F.lag("y").over(down))
    out = kept.groupBy(*PAGE, "header_y", "footer_y").agg(
        F.count("*").alias("n"), F.max("y").alias("last_y"), F.avg(F.when(F.col("step") < 50, F.col("step"))).alias("step"), F.min("x0").alias("x0"), F.max("x1").alias("x1")
    )
    margin = F.when(F.col("n") >= 3, F.coalesce(F.col("step") * 1.5, F.lit(20.0))).otherwise(20.0)
    bottom = F.coalesce(F.col("footer_y") - 10, F.col("last_y") + margin)
    found = out.where("n >= 2").select(*PAGE, "x0", (F.col("header_y") - 5).alias("y0"), "x1", bottom.alias("y1"))
    return keep_tall(found, least)


def largest_table(tables: DataFrame) -> DataFrame:
    whole = F.struct("x0", "y0", "x1", "y1")
    return tables.groupBy(*PAGE).agg(F.max_by(whole, bbox.area(whole)).alias("b")).select(*PAGE, "b.*")


def keep_tall(tables: DataFrame, least: float = 50) -> DataFrame:
    return tables.where(F.col("y1") - F.col("y0") >= least)


def expand_tables(tables: DataFrame, margin: float = 20) -> DataFrame:
    grown = bbox.expand(F.struct("x0", "y0", "x1", "y1"), margin)
    return tables.withColumn("b", grown).select(*PAGE, "b.*")


def iban_candidates(words: DataFrame, reach: int = 9, gap: float = 10, tilt: float = 3) -> DataFrame:
    """Account numbers and their boxes: a word like a country code and two digits, and near words after it on its line."""
    order = Window.partitionBy(*PAGE).orderBy("word_seq")
    word = F.struct("text", "x0", "x1", "top", "bottom")
    near = words.withColumn("run", F.collect_list(word).over(order.rowsBetween(0, reach))).where(F.col("text").rlike(r"^[A-Z]{2}\d{2}"))

    def absorb(acc: Column, w: Column) -> Column:
        fits = acc["open"] & (F.abs(w["top"] - acc["top"]) <= tilt) & (w["x0"] - acc["x1"] <= gap)
        return F.struct(
            fits.alias("open"),
            F.when(fits, F.concat(acc["text"], w["text"])).otherwise(acc["text"]).alias("text"),
            acc["x0"].alias("x0"),
            F.when(fits, w["x1"]).otherwise(acc["x1"]).alias("x1"),
            acc["top"].alias("top"),
            F.when(fits, F.greatest(acc["bottom"], w["bottom"])).otherwise(acc["bottom"]).alias("bottom"),
        )

    start = F.struct(
        F.lit(True).alias("open"), F.lit("").alias("text"), F.col("x0").alias("x0"), F.col("x0").cast("double").alias("x1"), F.col("top").alias("top"), F.col("bottom").alias("bottom")
    )
    folded = near.withColumn("c", F.aggregate("run", start, absorb))
    # the longest leading part that is a valid number
    cleaned = iban.clean_iban(F.col("c.text"))
    tried = F.filter(F.transform(F.sequence(F.lit(15), F.lit(34)), lambda n: F.substring(cleaned, F.lit(1), n)), iban.is_valid_iban)
    return folded.withColumn("iban", F.get(tried, F.lit(0))).where("iban is not null").select(
        *PAGE, "word_seq", "iban", F.col("c.x0").alias("x0"), F.col("c.top").alias("y0"), F.col("c.x1").alias("x1"), F.col("c.bottom").alias("y1")
    )


def candidates_or_text(candidates: DataFrame, pages: DataFrame, width: float, height: float) -> DataFrame:
    """Candidates of words; where a page has none, the number in its text, placed in the top third."""
    found = pages.withColumn("iban", iban.find_iban(F.col("text"))).where("iban is not null")
    lacking = found.join(candidates.select(*PAGE).distinct(), [*PAGE], "left_anti")
    placed = lacking.select(
        *PAGE, F.lit(0).cast("long").alias("word_seq"), "iban", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"),
        F.lit(float(width)).alias("x1"), F.lit(height / 3).alias("y1"),
    )
    return candidates.unionByName(placed)


def outside_tables(candidates: DataFrame, tables: DataFrame) -> DataFrame:
    """Spatial anti-join: candidates that touch no table of their page."""
    t = tables.select(F.col("file").alias("tf"), F.col("page_no").alias("tp"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    touch = (F.col("x0") <= F.col("t_x1")) & (F.col("t_x0") <= F.col("x1")) & (F.col("y0") <= F.col("t_y1")) & (F.col("t_y0") <= F.col("y1"))
    return candidates.join(t, (F.col("file") == F.col("tf")) & (F.col("page_no") == F.col("tp")) & touch, "left_anti")


def score_candidates(candidates: DataFrame, height: float) -> DataFrame:
    share = F.col("y0") / height
    return candidates.withColumn("score", F.when(share <= 0.25, 50.0).otherwise(0.0) + 30 * (1 - share))


def best_candidate(scored: DataFrame) -> DataFrame:
    return scored.groupBy("file").agg(F.max_by(F.struct("iban", "score"), F.struct("score", -F.col("word_seq"))).alias("b")).select("file", "b.*")


def multiline_dates(words: DataFrame, date_range: tuple = schema.DEFAULT_COLUMNS["Date"], top: float = 0, bottom: float = float("inf")) -> DataFrame:
    """Whether less than 60 % of the lines of a page's date column, three or more, have a date: a month's name or a slash."""
    inside = (F.col("x0") >= date_range[0]) & (F.col("x1") <= date_range[1]) & (F.col("top") >= top) & (F.col("bottom") <= bottom)
    dated = text.contains_any(F.lower("text"), DATE_MARKS)
    lines = words.groupBy(*PAGE, (F.rint(F.col("top") / 5) * 5).alias("y")).agg(
        F.max(F.when(inside, 1).otherwise(0)).alias("counts"), F.max(F.when(inside & dated, 1).otherwise(0)).alias("dated")
    )
    out = lines.groupBy(*PAGE).agg(F.sum("counts").alias("n"), F.sum("dated").alias("dated"))
    return out.select(*PAGE, ((F.col("n") >= 3) & (F.col("dated") > 0) & (F.col("dated") / F.col("n") < 0.6)).alias("multiline"))


def estimated_rows(tables: DataFrame, height: float = 15) -> DataFrame:
    return largest_table(tables).groupBy("file").agg(F.sum(F.floor((F.col("y1") - F.col("y0")) / height)).alias("estimate"))
