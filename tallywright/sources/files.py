"""Statement files: discovery, decoding and stored tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = "file string, page_no int, word_seq long, text string, x0 double, x1 double, top double, bottom double, error string"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
_WORDS = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in WORDS.split(", "))])


def discover(spark: SparkSession, folder: str, recursive: bool = True, pattern: str = "*.pdf", content: bool = False) -> DataFrame:
    """(path, filename, length, modificationTime, file_ord) of files; file_ord rises with the path. Content is read only if wanted."""
    local = folder.removeprefix("file:")
    if "://" not in folder:
        if os.path.exists(local) and not os.path.isdir(local):
            raise ValueError(f"{folder} is not a folder")
        os.makedirs(local, exist_ok=True)
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select("path", "length", "modificationTime", *(["content"] if content else []))
    )
    if content:  # contents are not sorted
        return found.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    return found.orderBy("path").withColumns({"filename": F.element_at(F.split("path", "/"), -1), "file_ord": F.monotonically_increasing_id()})


def decode_pdf(path: str, content: bytes) -> Iterator[dict]:
    """Words of a PDF by the optional decoder library."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            for seq, w in enumerate(page.extract_words() or []):
                yield {"file": path, "page_no": page.page_number, "word_seq": seq, **{k: w[k] for k in ("text", "x0", "x1", "top", "bottom")}}


def read_words(spark: SparkSession, folder: str, recursive: bool = True, decode: Callable[[str, bytes], Iterator[dict]] = decode_pdf) -> DataFrame:
    """Words of all files of a folder; a file that fails gives one row with the error and stops nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    rows = list(decode(path.as_py(), content.as_py()))
                except Exception as e:  # one bad file must not end the job
                    rows = [{"file": path.as_py(), "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, _WORDS)

    return discover(spark, folder, recursive, content=True).select("path", "content").mapInArrow(run, WORDS)


def store_words(words: DataFrame, folder: str) -> None:
    """Words sorted by file, page and height, so that crops prune row groups."""
    words.repartition("file").sortWithinPartitions("file", "page_no", "top").write.mode("overwrite").parquet(folder)


def read_json(spark: SparkSession, path: str, schema: str = "") -> DataFrame:
    """A JSON file of records; an empty frame where there is no file."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], schema or T.StructType())
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)
