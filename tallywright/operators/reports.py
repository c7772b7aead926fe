"""Reports over transactions: months, totals, expenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.functions import amounts, dates, text

HIGH = 2.0
NEAR = 0.05
MONTH_GAP = (25, 35)


def rounded(value: Column) -> Column:
    """Two places, ties to even, on exact numbers; a double at last."""
    return F.bround(value, 2).cast("double")


def _positive(value: Column) -> Column:
    return F.when(value > 0, value)


def monthly_summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums and counts of positive debits and credits by month, and by further columns; unreadable dates are ``Unknown``."""
    dated = df.select(
        *by,
        dates.month_key(dates.parse_date(dates.add_year(F.col("date"), F.col("statement_year")))).alias("month"),
        _positive(amounts.to_decimal(F.col("debit"))).alias("d"),
        _positive(amounts.to_decimal(F.col("credit"))).alias("c"),
    )
    zero = F.lit(0).cast(amounts.DECIMAL)
    return dated.groupBy(*by, "month").agg(
        rounded(F.coalesce(F.sum("d"), zero)).alias("debit"),
        F.count("d").alias("debit_transactions"),
        rounded(F.coalesce(F.sum("c"), zero)).alias("credit"),
        F.count("c").alias("credit_transactions"),
    )


def column_totals(df: DataFrame, patterns=("debit", "credit")) -> DataFrame:
    """Sum of each column whose name contains a pattern; cells that are no numbers are skipped."""
    names = schema.matching_columns(df.columns, patterns)
    return df.agg(*[F.coalesce(F.sum(amounts.to_float(F.col(f"`{n}`")).cast(amounts.DECIMAL)), F.lit(0)).cast("double").alias(n) for n in names])


def totals_of(df: DataFrame, columns) -> DataFrame:
    """Sums of the named columns; names that the frame lacks are skipped."""
    return df.agg(*[F.coalesce(F.sum(amounts.to_float(F.col(f"`{n}`")).cast(amounts.DECIMAL)), F.lit(0)).cast("double").alias(n) for n in columns if n in df.columns])


def totals_row(totals: DataFrame, columns) -> DataFrame:
    """TOTAL in the date column, sums with two places, nothing elsewhere."""
    shown = [
        F.lit("TOTAL").alias(c)
        if schema.is_date_column(c)
        else amounts.money_text(F.col(c)).alias(c)
        if c in totals.columns
        else F.lit("").alias(c)
        for c in columns
    ]
    return totals.select(*shown)


def with_amount(df: DataFrame) -> DataFrame:
    """Adds amount: the absolute debit where there is one, else the credit."""
    return df.withColumn("amount", amounts.absolute_amount(F.col("debit"), F.col("credit")))


def exact_median(df: DataFrame, column: str, cells: int = 4096) -> DataFrame:
    """One row, ``median_amount``: the exact median without gathering all values in one task.

    An approximate quantile a little below and one a little above the middle
    bracket it, whatever lies far out. Values below are counted, those inside
    are counted in equal cells, and running counts over the cells (a bounded
    number) tell which of them hold the middle values. Only those cells'
    distinct values are then ordered.
    """
    value = F.col(column).cast("double")
    known = df.where(value.isNotNull()).select(value.alias("v"))
    around = known.agg(F.percentile_approx("v", F.array(F.lit(0.495), F.lit(0.505)), F.lit(1000)).alias("q"), F.count("*").alias("all"))
    ends = F.broadcast(around.select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "all"))  # one row
    share = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    cell = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), cells).otherwise(F.least(F.lit(cells - 1), F.floor(share * cells))).cast("int")
    placed = known.groupBy("v").agg(F.count("*").alias("n")).crossJoin(ends).withColumn("cell", cell)
    counts = placed.groupBy("cell", "all").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy("cell"))
    middle = (
        counts.withColumn("upto", upto)
        .withColumn("before", F.col("upto") - F.col("n"))
        .where((F.col("before") < F.floor((F.col("all") + 2) / 2)) & (F.col("upto") >= F.floor((F.col("all") + 1) / 2)))
        .select(F.col("cell").alias("c"), F.col("before"))
    )
    near = placed.join(F.broadcast(middle), F.col("cell") == F.col("c"))
    ranked = near.withColumn("last", F.col("before") + F.sum("n").over(Window.partitionBy("cell").orderBy("v")))
    first = F.col("last") - F.col("n") + 1
    low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    hit = lambda k: F.max(F.when((first <= k) & (F.col("last") >= k), F.col("v")))
    return ranked.agg(((hit(low) + hit(high)) / 2).alias("median_amount"))


def expense_statistics(df: DataFrame) -> DataFrame:
    """One row: mean, median, sample deviation, debits and credits over positive amounts."""
    valued = with_amount(df).where("amount > 0")
    is_debit = ~text.is_blank(F.col("debit"))
    zero = F.lit(0.0)
    sums = valued.agg(
        F.coalesce(F.round(F.avg(F.col("amount").cast("double")), 2), zero).alias("mean_amount"),
        F.coalesce(F.round(F.stddev_samp(F.col("amount").cast("double")), 2), zero).alias("std_amount"),
        F.coalesce(rounded(F.sum(F.when(is_debit, F.col("amount")))), zero).alias("total_debits"),
        F.coalesce(rounded(F.sum(F.when(~is_debit, F.col("amount")))), zero).alias("total_credits"),
    )
    median = exact_median(valued, "amount").select(F.coalesce(F.round("median_amount", 2), zero).alias("median_amount"))
    return sums.crossJoin(F.broadcast(median)).select("mean_amount", "median_amount", "std_amount", "total_debits", "total_credits")


def high_value(df: DataFrame, order: str = "ord") -> DataFrame:
    """Rows whose amount is beyond the mean by more than two deviations, both as reported."""
    amount = F.col("amount").cast("double")
    stats = F.broadcast(  # one row
        with_amount(df)
        .where("amount > 0")
        .agg(F.coalesce(F.round(F.avg(amount), 2), F.lit(0.0)).alias("mean_amount"), F.coalesce(F.round(F.stddev_samp(amount), 2), F.lit(0.0)).alias("std_amount"))
    )
    value = F.col("amount").cast("double")
    return (
        with_amount(df)
        .where("amount > 0")
        .crossJoin(stats)
        .where((F.col("std_amount") > 0) & (value > F.col("mean_amount") + HIGH * F.col("std_amount")))
        .select(
            order,
            "date",
            "details",
            value.alias("amount"),
            F.round((value - F.col("mean_amount")) / F.col("std_amount"), 2).alias("z_score"),
        )
    )


def _day(day: str | None) -> Column:
    """The DATE column of that name, or the day that the printed date stands for."""
    return F.col(day) if day else dates.parse_date(dates.add_year(F.col("date"), F.col("statement_year")))


def recurring_charges(df: DataFrame, key: str = "details", by: tuple[str, ...] = (), day: str | None = None) -> DataFrame:
    """Equal details whose amounts stay within 5 % of their mean at monthly distances; rows without details are no vendor's.

    ``day`` names a DATE column of frames that have one: printed dates hold
    four digits of a year at most, and what cannot be read is the epoch.
    The positive gaps between sorted days add up to last minus first, and there
    is one less of them than there are different days: no window over a
    vendor's rows is needed, however many a vendor has.
    """
    valued = with_amount(df).withColumn("day", _day(day))
    value = _positive(F.col("amount"))
    grouped = valued.where(F.col(key) != "").groupBy(*by, key).agg(
        F.count("*").alias("n"),
        F.count(value).alias("valued"),
        F.avg(value.cast("double")).alias("mean"),
        F.min(value.cast("double")).alias("low"),
        F.max(value.cast("double")).alias("high"),
        F.datediff(F.max("day"), F.min("day")).alias("reach"),
        F.count_distinct("day").alias("days"),
    )
    gap = F.try_divide(F.col("reach"), F.col("days") - 1)
    steady = (F.col("high") - F.col("mean") <= NEAR * F.col("mean")) & (F.col("mean") - F.col("low") <= NEAR * F.col("mean"))
    return (
        grouped.withColumn("mean_gap", gap)
        .where((F.col("n") >= 2) & (F.col("valued") >= 2) & steady & F.col("mean_gap").between(*MONTH_GAP))
        .select(
            *by,
            key,
            F.col("n").alias("occurrences"),
            F.round("mean", 2).alias("average_amount"),
            F.round("mean_gap", 1).alias("average_gap_days"),
            F.lit("monthly").alias("frequency"),
        )
    )


def repeated_vendors(df: DataFrame, key: str = "details", by: tuple[str, ...] = ()) -> DataFrame:
    """Equal details that occur twice or more: all rows are counted, the average is over positive amounts; rows without details are no vendor's."""
    value = _positive(F.col("amount"))
    return (
        with_amount(df)
        .where(F.col(key) != "")
        .groupBy(*by, key)
        .agg(
            F.count("*").alias("n"),
            rounded(F.sum(value)).alias("total"),
            rounded(F.sum(value) / F.count(value)).alias("average"),
            F.min(value).cast("double").alias("lowest"),
            F.max(value).cast("double").alias("highest"),
        )
        .where("n >= 2 and total is not null")
    )


def vendor_transactions(df: DataFrame, found: DataFrame, key: str = "details", order: str = "ord", day: str | None = None) -> DataFrame:
    """Rows of the vendors of ``found``, the recurring or the repeated ones: key, date, amount, and day and order to sort by.

    A frame beside the aggregates: no list of a vendor's rows is gathered.
    """
    vendors = found.select(F.col(key).alias("vendor"))
    amount = F.coalesce(rounded(F.col("amount")), F.lit(0.0)).alias("amount")
    listed = with_amount(df).select(key, "date", amount, _day(day).alias("day"), order)
    return listed.join(vendors, F.col(key).eqNullSafe(F.col("vendor")), "left_semi")


def expense_transactions(df: DataFrame, day: str | None = None) -> DataFrame:
    """Transactions behind both vendor findings, for the file sink: section, details, date, amount, day, ord."""
    parts = {"recurring_charges": recurring_charges(df, day=day), "repeated_vendors": repeated_vendors(df)}
    first, second = (vendor_transactions(df, found, day=day).select(F.lit(n).alias("section"), "*") for n, found in parts.items())
    return first.unionByName(second)


def similar_descriptions(df: DataFrame) -> DataFrame:
    name = F.lower(text.strip(F.col("details")))
    return df.groupBy(name.alias("description")).agg(F.count("*").alias("n"))


def expense_report(df: DataFrame, day: str | None = None) -> DataFrame:
    """All four findings as one JSON document a row, for the file sink; built of already small results."""
    parts = {
        "statistics": expense_statistics(df),
        "recurring_charges": recurring_charges(df, day=day),
        "high_value": high_value(df),
        "repeated_vendors": repeated_vendors(df),
    }
    rows = [p.select(F.lit(n).alias("section"), F.to_json(F.struct(*p.columns)).alias("entry")) for n, p in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def run_summary(processed: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, files with transactions, pages read, transactions, duplicates. ``files`` has a row and a number of pages for each."""
    counted = processed.agg(
        F.count_distinct("filename").alias("files_extracted"),
        F.count(F.when(~F.col("is_duplicate"), 1)).alias("transactions"),
        F.count(F.when(F.col("is_duplicate"), 1)).alias("duplicates"),
    )
    read = files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages_read"))
    return read.crossJoin(F.broadcast(counted))  # one row each
