"""New ledger files as a stream, with the same transforms as in batch.

Monthly sums run on event time: a month's row is final once the watermark has
passed it. Duplicates need owners from all batches before, which a watermark
cannot keep; each batch therefore meets a stored table of key owners.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import amounts, dates


def read_ledger(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def monthly_stream(stream: DataFrame, delay: str = "60 days") -> DataFrame:
    """Sums of positive debits and credits by 30-day event-time window."""
    timed = stream.withColumn("at", dates.parse_date(dates.add_year(F.col("date"), F.col("statement_year"))).cast("timestamp"))
    positive = lambda c: F.when(amounts.to_decimal(F.col(c)) > 0, amounts.to_decimal(F.col(c)))
    return (
        timed.withWatermark("at", delay)
        .groupBy(F.window("at", "30 days"))
        .agg(F.sum(positive("debit")).cast("double").alias("debit"), F.sum(positive("credit")).cast("double").alias("credit"), F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "debit", "credit", "n")
    )


def deduplicating_sink(owners: str, out: str, key: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: marks duplicates against owners of earlier batches and of its own.

    A replayed batch writes the same folders again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("_key", key())
        mine = keyed.groupBy("_key").agg(F.min_by("filename", "ord").alias("_mine"))
        try:
            known = spark.read.parquet(owners).where(F.col("batch") < number)
        except AnalysisException:  # no batch before
            known = None
        if known is not None:
            mine = mine.join(known.select("_key", F.col("owner").alias("_old")), "_key", "left")
        else:
            mine = mine.withColumn("_old", F.lit(None).cast("string"))
        mine.where("_old is null").select("_key", F.col("_mine").alias("owner")).write.mode("overwrite").parquet(f"{owners}/batch={number}")
        marked = keyed.join(mine, "_key").withColumn("is_duplicate", F.col("filename") != F.coalesce("_old", "_mine"))
        marked.drop("_key", "_mine", "_old").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write
