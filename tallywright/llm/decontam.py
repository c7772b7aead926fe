"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an
item of fewer words is one window). A window is a set of word shingles; a
document contains it only if it has all of them, so by the prefix principle
(prefix length = size - required overlap + 1 = 1) the rarest shingle alone is
the necessary prefix token. Rarity is the exact number of occurrences of each
benchmark shingle in all documents. Documents are probed with prefix tokens
only; candidates pass a positional bound (the shingle's offset inside the
window fixes where the window starts) and a length bound (the window must end
inside the document) before the words are compared one by one.

The benchmark's side is collected in blocks of at most ``block_bytes`` of
item text, whatever the benchmark's size; each block is one more narrow pass
over the documents, so nothing that grows is broadcast and no row of
``documents`` is ever shuffled.

Edge cases: a null or empty text has no words and is never hit; a null, empty
or wordless item has no window; windows of items whose item_id is null mark
words but are no item, so they count in n_hit and not among the items;
repeated document rows each get a row; repeated items count once per
``item_id``; empty tables give an empty result or unhit rows; other columns of
either table are ignored; ``clean_documents`` carries columns of any name.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import Shared, portions, utf8

SHINGLE = 5
WINDOW = 10
BLOCK_BYTES = 8_000_000

#: [0-9a-z] and bytes of non-ASCII characters stay, A-Z are lowered, all else parts words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class WindowIndex:
    """Windows of one block of items, with the parts that are probed."""

    def __init__(self, items: list[tuple], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                named = owners[ids[at : at + window]]
                if item is not None:
                    named.add(str(item))
        self.windows = list(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.shingle = shingle
        self.shingles: dict[tuple, int] = {}
        for w in self.windows:
            for part in self.parts(w):
                self.shingles.setdefault(part, len(self.shingles))
        self.lengths = sorted({len(s) for s in self.shingles})
        self.tables = {n: self.table([s for s in self.shingles if len(s) == n]) for n in self.lengths}
        self.postings: dict[int, list[tuple[int, int]]] = {}

    def parts(self, window: tuple) -> list[tuple]:
        n = min(self.shingle, len(window))
        return [window[i : i + n] for i in range(len(window) - n + 1)]

    def table(self, shingles: list[tuple]):
        codes = fold(np.array(shingles, dtype=np.int64), len(shingles[0]), 0)
        order = np.argsort(codes, kind="stable")
        return codes[order], np.array([self.shingles[shingles[i]] for i in order])

    def choose(self, counts: dict[int, int]) -> None:
        """Each window's rarest shingle is its prefix token; one that never occurs rules the window out."""
        postings = defaultdict(list)
        for k, w in enumerate(self.windows):
            ranked = sorted((counts.get(self.shingles[p], 0), self.shingles[p], at) for at, p in enumerate(self.parts(w)))
            if ranked and ranked[0][0]:
                postings[ranked[0][1]].append((k, ranked[0][2]))
        self.postings = dict(postings)
        kept = np.array(sorted(postings), dtype=np.int64)
        self.tables = {n: (codes[m], refs[m]) for n, (codes, refs) in self.tables.items() if (m := np.isin(refs, kept)).any()}

    def found(self, ids: np.ndarray):
        """(position, shingle) of every occurrence of an indexed shingle; -1 in ids matches nothing."""
        known = ids >= 0
        for n, (codes, refs) in self.tables.items():
            if len(ids) < n:
                continue
            full = known[: len(ids) - n + 1].copy()
            for k in range(1, n):
                full &= known[k : len(ids) - n + 1 + k]
            at = np.flatnonzero(full)
            if not len(at):
                continue
            code = fold(ids, n, at)
            left, right = np.searchsorted(codes, code), np.searchsorted(codes, code, side="right")
            for position, lo, hi in zip(at[left < right], left[left < right], right[left < right]):
                for ref in refs[lo:hi]:
                    yield int(position), int(ref)

    def occurrences(self, ids: np.ndarray):
        """Verified (start, window) pairs."""
        for position, ref in self.found(ids):
            for k, offset in self.postings.get(ref, ()):
                w, start = self.windows[k], position - offset
                if start >= 0 and start + len(w) <= len(ids) and tuple(ids[start : start + len(w)].tolist()) == w:
                    yield start, k


def fold(ids: np.ndarray, n: int, at) -> np.ndarray:
    """A 64-bit code of n ids: of rows (2-d) or of the runs that start at positions ``at``."""
    code = np.zeros(len(ids) if ids.ndim == 2 else len(at), dtype=np.uint64)
    for k in range(n):
        part = ids[:, k] if ids.ndim == 2 else ids[at + k]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) ^ (part.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        code ^= code >> np.uint64(29)
    return code


def _identified(index: WindowIndex, texts: list):
    """Per portion of a batch: word ids with a -1 after each text, and where each text starts."""
    get = index.vocabulary.get
    for lo, hi in portions(texts):
        ids: list[int] = []
        starts = []
        for text in texts[lo:hi]:
            starts.append(len(ids))
            ids.extend([get(w, -1) for w in words_of(text)])
            ids.append(-1)
        yield lo, np.array(ids, dtype=np.int64), np.array([*starts, len(ids)], dtype=np.int64)


def _count_pass(index_of):
    def run(batches):
        index, counts = index_of(), defaultdict(int)
        for batch in batches:
            for _, ids, _ in _identified(index, utf8(batch.column(0))):
                for _, ref in index.found(ids):
                    counts[ref] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["ref", "n"])

    return run


def _match_pass(index_of, text_at: int, schema_names: list[str]):
    def run(batches):
        index = index_of()
        for batch in batches:
            texts = utf8(batch.column(text_at))
            n_words = np.zeros(len(texts), dtype=np.int64)
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for base, ids, starts in _identified(index, texts):
                n_words[base : base + len(starts) - 1] = np.diff(starts) - 1
                for start, k in index.occurrences(ids):
                    row = int(np.searchsorted(starts, start, side="right")) - 1
                    begin = start - int(starts[row])
                    spans[base + row].append((begin, begin + len(index.windows[k])))
                    items[base + row].update(index.owners[k])
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            old = columns.get("items")
            if old is not None:
                spans = [[(x["lo"], x["hi"]) for x in a] + b for a, b in zip(columns["spans"].to_pylist(), spans)]
                items = [set(a) | b for a, b in zip(old.to_pylist(), items)]
            columns["n_words"] = pa.array(n_words, pa.int64())
            columns["spans"] = pa.array(
                [[{"lo": a, "hi": b} for a, b in sorted(set(s))] for s in spans],
                pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])),
            )
            columns["items"] = pa.array([sorted(s) for s in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema_names], schema_names)

    return run


def _matched(documents: DataFrame, benchmark: DataFrame, window: int, shingle: int, block_bytes: int) -> DataFrame:
    """The columns of documents under the names c0, c1 and so on, which clash with nothing, with n_words, spans and items."""
    spark: SparkSession = documents.sparkSession
    items = benchmark.where("text is not null").select("item_id", "text")
    volume = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // block_bytes))
    at = documents.columns.index("text")
    found = documents.toDF(*[f"c{k}" for k in range(len(documents.columns))])
    added = {"n_words": "bigint", "spans": "array<struct<lo:bigint,hi:bigint>>", "items": "array<string>"}
    names = [*found.columns, *added]
    schema = T.StructType(list(found.schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        index = WindowIndex([(r[0], r[1].encode()) for r in part.toLocalIterator()], window, shingle)
        held = Shared(spark, index)
        occurred = documents.where("text is not null").select("text").mapInArrow(_count_pass(lambda h=held: h.value), "ref long, n long")
        counts = {r[0]: r[1] for r in occurred.groupBy("ref").agg(F.sum("n")).toLocalIterator()}
        index.choose(counts)
        chosen = Shared(spark, index)
        found = found.mapInArrow(_match_pass(lambda h=chosen: h.value, at, names), schema)
    return found


def n_hit_of(spans) -> Column:
    """Words inside any span. Spans are sorted by start: a word counts once, where its reach goes beyond all spans before."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["hi"] - F.greatest(s["lo"], acc["end"]), F.lit(0).cast("long"))).alias("n"),
            F.greatest(acc["end"], s["hi"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): spans are the word ranges of found windows."""
    found = _matched(documents.select("doc_id", "text"), benchmark, window, shingle, block_bytes)
    return found.select(F.col("c0").alias("doc_id"), "n_words", n_hit_of("spans").alias("n_hit"), F.array_sort("items").alias("items"), "spans")


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no window, with all their columns, whatever these are called."""
    found = _matched(documents, benchmark, window, shingle, block_bytes)
    return found.where(F.size("spans") == 0).drop("n_words", "spans", "items").toDF(*documents.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
