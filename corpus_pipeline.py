"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and is written as Parquet to the shared folder and read again before the
next one. All but the last return the columns of ``documents``.

1. quality: documents that the co-trained classifier rejects go.
2. near_duplicates: SimHash near-dedup, by links of a Jaccard similarity of 0.8
   or more of the texts' five-word shingles; the smallest doc_id stays.
3. decontamination: documents that hold a benchmark window go.
4. secrets: found spans are masked in the text; no document goes.
5. tokens: byte-level BPE ids of what is left, with the round trip checked.

Rows whose doc_id is null are no near-duplicates of any; all other stages treat
them like the rest: bad or contaminated ones go, secrets are masked. Null and
empty texts are copies of one another. Extra columns, of any name, come along
to the last stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import bpe, cotrain, decontam, secret_scan, simhash
from tallywright.llm.common import Scratch, own_name

#: The stages train and compare by models and trees that SQL cannot express;
#: tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotrain.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id. Rows that share an id stay or go together; of those that share the text too one stays."""
    once = docs.where("doc_id is null").unionByName(docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])) if _repeats(docs) else docs
    found = simhash.similar_documents(docs)
    gone = own_name("gone", docs)
    lost = found.groupBy(F.col("doc_id").alias(gone)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays").select(gone)
    return once.join(lost, F.col("doc_id") == F.col(gone), "left_anti")


def _repeats(docs: DataFrame) -> bool:
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    return not ids.where("count > 1").isEmpty()


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, ledger = secret_scan.scan(docs)
    return secret_scan.mask(docs, ledger)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
