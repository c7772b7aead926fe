"""WARC archives: writing, and reading back with boundary-chain verification.

Writing. Pages of equal payload (``REVISIT_BYTES`` or more) have one response,
that of the smallest page_id; the others become revisit records that refer to
it. Digests alone are grouped; payloads are never shuffled for it beyond the
join that hands each page its referred id. Records go out through Spark's text
writer with CRLF as line separator, so archives are committed like any output
of a job, on any file system, and a lost task is simply written again.

Reading. Tasks scan archives for every place where a record could start (also
inside payloads), parse its header and emit the candidate's offset with that
of its successor. Pointer jumping from the file's start, doubling the jump
each turn, keeps the candidates that the chain reaches; record starts that a
payload merely quotes are never reached. Only offsets and header fields are
grouped by file. An archive is read as one binary value. The writer rolls
files so that none holds more than ``FILE_BYTES`` before compression, unless a
single record does; archives longer than ``ARCHIVE_BYTES``, on disk or after
decompression, raise an error. Compressed members, one or many, are read alike.

Edge cases: null html is an empty payload; a null url is an empty target;
line breaks in urls become spaces; repeated page rows each get a record, and
rows that repeat the smallest page_id of a payload are all responses; a null
page_id is never referred to unless all pages of a payload have none, which
then are all responses; an empty table gives empty archives and no records;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import Scratch

REVISIT_BYTES = 100
RECORDS_PER_FILE = 2000
FILE_BYTES = 500_000_000
ARCHIVE_BYTES = 1_000_000_000
#: More than the header lines of a record take without the url.
HEADER_BYTES = 1000
DATE = "2025-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, record): whole WARC records as text."""
    prepared = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).select(
        "*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size")
    )
    shared = (
        prepared.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    revisits = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    joined = prepared.join(shared, "digest", "left").withColumn("refers", revisits)
    block = F.when(F.col("refers").isNull(), F.concat(F.lit(HTTP), F.col("payload"))).otherwise(F.lit(HTTP))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("refers").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            F.col("refers").isNotNull(),
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", urn(F.col("refers"))),
                line("WARC-Payload-Length", F.col("size").cast("string")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
        F.lit("\r\n\r\n"),
    )
    return joined.withColumn("block", block).select("page_id", record.alias("record"))


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES, compression: str = "none") -> None:
    # the writer ends each value with the last CRLF of the record
    body = records(pages, least).select(F.expr("substring(record, 1, length(record) - 2)").alias("value"))
    body.write.mode("overwrite").option("lineSep", "\r\n").option("compression", compression).option(
        "maxRecordsPerFile", records_per_file(pages)
    ).text(folder)


def records_per_file(pages: DataFrame) -> int:
    """So many that even the longest record stays within FILE_BYTES as often."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + HEADER_BYTES
    longest = pages.agg(F.max(size)).first()[0] or 1
    return max(1, min(RECORDS_PER_FILE, FILE_BYTES // longest))


_START = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")
_CANDIDATE = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("successor", pa.int64()),
        ("page_id", pa.string()),
        ("record_type", pa.string()),
        ("target", pa.string()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)


def candidates(path: str, content: bytes):
    """One row for each place of an archive where a well-formed header stands."""
    for hit in _START.finditer(content):
        close = content.find(b"\r\n\r\n", hit.end() - 2)
        if close < 0:
            continue
        fields = {}
        for line in content[hit.end() : close].split(b"\r\n"):
            if not (m := _FIELD.fullmatch(line)):
                break
            fields[m[1].lower()] = m[2].strip()
        else:
            length = fields.get(b"content-length", b"")
            if not length.isdigit():
                continue
            begin, stop = close + 4, close + 4 + int(length)
            if content[stop : stop + 4] != b"\r\n\r\n":
                continue
            text = {k: v.decode("utf-8", "replace") for k, v in fields.items()}
            digest, size = text.get(b"warc-payload-digest", "").removeprefix("sha256:"), text.get(b"warc-payload-length", "")
            if text.get(b"warc-type") != "revisit":
                head = content.find(b"\r\n\r\n", begin, stop)
                payload = memoryview(content)[begin if head < 0 else head + 4 : stop]
                digest, size = hashlib.sha256(payload).hexdigest(), str(len(payload))
            yield (
                path,
                hit.start(),
                stop + 4,
                text.get(b"warc-record-id", "").removeprefix("<urn:page:").removesuffix(">"),
                text.get(b"warc-type", ""),
                text.get(b"warc-target-uri", ""),
                text.get(b"warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">"),
                int(size) if size.isdigit() else None,
                digest,
            )


def unpacked(raw: bytes, most: int) -> bytes:
    """The bytes of an archive whose gzip members may be many; more than ``most`` of them are an error."""
    parts, size = [], 0
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(raw, most - size + 1))
        size += len(parts[-1])
        if size > most:
            raise ValueError(f"an archive of more than {most} bytes cannot be read")
        raw = member.unused_data
    return b"".join(parts) if parts else raw


def _scan(batches):
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            raw = unpacked(content.as_py(), ARCHIVE_BYTES)
            rows = list(candidates(path.as_py(), raw))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_CANDIDATE), _CANDIDATE)], schema=_CANDIDATE)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which records the chain from offset zero reaches; the jump length doubles each turn."""
    order = np.argsort(offsets)
    n = len(offsets)
    at = np.searchsorted(offsets[order], successors)
    exact = (at < n) & (offsets[order][np.minimum(at, n - 1)] == successors)
    jump = np.full(n + 1, n)
    jump[order] = np.where(exact[order], order[np.minimum(at[order], n - 1)], n)
    marked = np.zeros(n + 1, dtype=bool)
    marked[:n] = offsets == 0
    for _ in range(max(1, n).bit_length()):
        marked[jump[np.flatnonzero(marked)]] = True
        jump = jump[jump]
    return marked[:n]


def _chain(table: pa.Table) -> pa.Table:
    keep = reachable(table.column("offset").to_numpy(), table.column("successor").to_numpy())
    return table.filter(pa.array(keep))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Verified records of all archives in a folder, with offsets and payload digests."""
    schema = "path string, offset long, successor long, page_id string, record_type string, target string, refers_to string, payload_bytes long, payload_digest string"
    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    longer = [r[0] for r in files.where(F.col("length") > ARCHIVE_BYTES).select("path").take(3)]
    if longer:
        raise ValueError(f"archives longer than {ARCHIVE_BYTES} bytes cannot be read: {', '.join(longer)}")
    found = files.select("path", "content").mapInArrow(_scan, schema)
    return found.groupBy("path").applyInArrow(_chain, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{scratch.root}/archives", compression="gzip")
    return read_archives(spark, f"{scratch.root}/archives").select(
        F.expr("try_cast(page_id as bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", F.expr("try_cast(refers_to as bigint)")).alias("refers_to"),
    )
