"""Suffix-array deduplication of repeated byte strings.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document of smaller doc_id, or earlier in the same one.

Shards. Each window of ``length`` bytes is owned by its minimizer, the
leftmost smallest hash among the window's ``GRAM``-byte strings, which depends
on the window's bytes alone. Equal windows thus share an owner, and the owner's hash
says where they meet. Runs of windows with one owner form a segment. Owners
that occur once in the whole corpus cannot repeat and go no further: counting
them moves one small row per owner, at most one per owner and batch of
documents, so a passage in a third of all documents is counted in the tasks
that read it. Segments of repeated owners are reduced to distinct ones per
batch and travel to their shards in compressed packs.

Suffix sorting. A shard joins its distinct segments with separators, builds
their suffix array by induced sorting (``suffix_array``: types, sorted
leftmost-smaller substrings, recursion, induction) and the permuted common
prefixes. At this shard size the recursion ends after one reduction, in rank
doubling. Neighbours whose common prefix has ``length`` bytes are equal
windows; the earliest of them stays, the others go.

An owner with more than ``HOT`` occurrences may stand in as many distinct
segments; its windows get owners anew, by a second hash, which deals them out
by what stands around the hot string. A batch makes at most ``FAN`` packs;
where there are more shards, packs of many shards are dealt again, ``FAN``
ways each time, until each holds one shard.

Edge cases: a null text is empty; texts shorter than ``length`` stay whole;
an empty table gives no rows; rows that repeat a doc_id and its text are one
document and get the same result; different texts of one doc_id are documents
in the order of their hashes; a row whose doc_id is null is neither searched
nor cut; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import Scratch, portions, utf8
from tallywright.llm.suffix_array import permuted_lcp, suffix_array

LENGTH = 100
GRAM = 20
HOT = 20_000
SHARD_BYTES = 1_000_000
FAN = 1024
#: Keys of hot owners that are broadcast at most, and bytes of text that a worker cuts at a time.
HOT_KEYS = 1_000_000
SLICE_BYTES = 16_000_000
_P = 0x100000001B3
_PLACES = 1 << 19
#: Changes the hash by which the windows of hot owners are dealt.
SECOND = 0x5851F42D4C957F2D


def rolling(data: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` bytes."""
    power = data.astype(np.uint64) + np.uint64(1)
    done, value, size = None, power, 1
    covered = 0
    left = width
    while left:
        if left & 1:
            if done is None:
                done = value
            else:
                keep = len(data) - covered - size + 1
                done = done[:keep] * np.uint64(pow(_P, size, 1 << 64)) + value[covered : covered + keep]
            covered += size
        left >>= 1
        if left:
            value = value[:-size] * np.uint64(pow(_P, size, 1 << 64)) + value[size:]
            size *= 2
    done = done ^ (done >> np.uint64(32)) ^ np.uint64(salt)
    done *= np.uint64(0xD6E8FEB86659FD93)
    return done ^ (done >> np.uint64(32))


def owners(data: np.ndarray, length: int, gram: int, salt: int = 0):
    """(owner hash, first window, windows) of each run of windows with one owner.

    An owner is a place: the leftmost of the smallest hashes in the window.
    """
    parts = []
    for at in range(0, len(data) - length + 1, _PLACES):
        part = data[at : at + _PLACES + length - 1]
        span = length - gram + 1
        low, size = rolling(part, gram, salt), 1
        low = (low & ~np.uint64(_PLACES * 2 - 1)) | np.arange(len(low), dtype=np.uint64)
        n = len(low) - span + 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        rest = span - size
        low = np.minimum(low[:n], low[rest : rest + n])
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        key = (low[first] // np.uint64(_PLACES * 2)).astype(np.int64)
        parts.append((key, first + at, np.diff(np.append(first, n))))
    return tuple(map(np.concatenate, zip(*parts)))


def _owner_pass(length: int, gram: int):
    """Per batch: an owner that occurs once (role 0), the first of several (1, with their number) or a further one (2)."""

    def run(batches):
        for batch in batches:
            ids, keys, runs = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if text and len(text) >= length:
                    key, first, _ = owners(np.frombuffer(text, np.uint8), length, gram)
                    ids.append(np.full(len(key), doc))
                    keys.append(key)
                    runs.append(np.arange(len(key), dtype=np.int32))
            if not keys:
                continue
            doc, key, at = map(np.concatenate, (ids, keys, runs))
            _, where, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            role = np.full(len(key), 2, dtype=np.int8)
            role[where] = np.minimum(count - 1, 1)
            n = np.where(role == 2, 0, count[inverse]).astype(np.int64)
            for lo in range(0, len(key), 500_000):
                hi = lo + 500_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[lo:hi]) for x in (key, doc, at, role, n)], ["key", "doc", "run", "role", "n"]
                )

    return run


def _pack(batches):
    """(doc_id, doc, packed, size): texts compressed for their way through a shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = utf8(batch.column(2))
        packed = [press.compress(t or b"") for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array([len(t or b"") for t in texts], pa.int64())],
            ["doc_id", "doc", "packed", "size"],
        )


def _merged(rows: list[tuple]) -> list[tuple]:
    """Sorted (doc, first window, windows) with adjoining runs joined."""
    out: list[list] = []
    for doc, lo, n in sorted(rows):
        if out and out[-1][0] == doc and lo <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], lo + n - out[-1][1])
        else:
            out.append([doc, lo, n])
    return out


_SEGMENT = pa.schema([("shard", pa.int64()), ("doc", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])


def _packed(held: dict) -> pa.RecordBatch:
    """Distinct segments as one compressed pack for each bucket of ``held``: bucket -> text -> (doc, lo, n, shard)."""
    packs = []
    for segments in held.values():
        table = pa.RecordBatch.from_arrays(
            [pa.array([v[k] for v in segments.values()], pa.int64()) for k in (3, 0, 1, 2)] + [pa.array(list(segments), pa.binary())], schema=_SEGMENT
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _SEGMENT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(table)
        packs.append(sink.getvalue().to_pybytes())
    return _rows(list(held), packs, [])


def _rows(buckets: list, packs: list, late: list[tuple]) -> pa.RecordBatch:
    """Rows of packs, and rows of windows that are settled."""
    n, m = len(packs), len(late)
    return pa.RecordBatch.from_arrays(
        [pa.array([*buckets, *[None] * m], pa.int64()), pa.array([*packs, *[None] * m], pa.binary())]
        + [pa.array([*[None] * n, *(r[k] for r in late)], pa.int64()) for k in range(3)],
        ["shard", "pack", "doc", "lo", "n"],
    )


def _unpacked(pack: bytes):
    part = pa.ipc.open_stream(pack).read_all()
    return zip(*(c.to_pylist() for c in part.columns))


def _keep_first(held: dict, text: bytes, doc: int, lo: int, n: int, late: list, shard: int = 0) -> None:
    """The earliest place of a segment stays in ``held``; all windows of a later one repeat it."""
    old = held.get(text)
    if old is None or (doc, lo) < old[:2]:
        held[text] = (doc, lo, n, shard)
        if old is not None and old[:2] != (doc, lo):
            late.append(old[:3])
    elif old[:2] != (doc, lo):
        late.append((doc, lo, n))


def _segment_pass(length: int, gram: int, shards: int, width: int):
    """Repeats settled within the batch as (doc, lo, n), distinct segments as packs for buckets of ``width`` shards."""

    def run(batches):
        inflate = zstandard.ZstdDecompressor()
        for whole in batches:
            sizes = whole.column(3).to_pylist()
            for at, stop in portions([range(n) for n in sizes], SLICE_BYTES):
                batch = whole.slice(at, stop - at)
                late: list[tuple] = []
                held: dict[int, dict] = {}

                def add(owner: int, segment: bytes, doc: int, lo: int, n: int) -> None:
                    shard = owner % shards
                    _keep_first(held.setdefault(shard // width, {}), segment, doc, lo, n, late, shard)

                for doc, packed, runs in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    text = inflate.decompress(packed)
                    if len(text) < length:
                        continue
                    key, first, size = owners(np.frombuffer(text, np.uint8), length, gram)
                    for code in set(runs):
                        k, hot = code >> 1, code & 1
                        lo, n = int(first[k]), int(size[k])
                        segment = text[lo : lo + n + length - 1]
                        if not hot:
                            add(int(key[k]), segment, doc, lo, n)
                            continue
                        for owner, begin, windows in zip(*(x.tolist() for x in owners(np.frombuffer(segment, np.uint8), length, gram, SECOND))):
                            add(owner, segment[begin : begin + windows + length - 1], doc, lo + begin, windows)
                yield _rows([], [], _merged(late))
                yield _packed(held)

    return run


def _deal_pass(width: int):
    """Packs of many shards as packs of ``width`` shards; segments that meet here are settled."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FAN):
                held: dict[int, dict] = {}
                late: list[tuple] = []
                for pack in batch.column(1).slice(at, FAN):
                    for shard, doc, lo, n, text in _unpacked(pack.as_py()):
                        _keep_first(held.setdefault(shard // width, {}), text, doc, lo, n, late, shard)
                yield _rows([], [], _merged(late))
                yield _packed(held)

    return run


def repeats(segments: dict, length: int) -> list[tuple]:
    """(doc, window) of every window of distinct segments that an earlier place also holds."""
    texts = list(segments)
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 2
    joined[begin + sizes - 1] = 1
    s = np.append(joined, 0)
    order = suffix_array(s, 258)
    prefix = permuted_lcp(s, order)
    place = np.array([v[:3] for v in segments.values()], dtype=np.int64)
    segment = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(segment)) - np.repeat(begin, sizes)
    window = np.append(offset < place[segment, 2], False)
    ranks, doc_rank = np.unique(place[:, 0], return_inverse=True)
    where = np.append(doc_rank[segment] * (1 << 34) + place[segment, 1] + offset, 0)
    sorted_windows = window[order]
    fresh = prefix[order] < length
    group = np.cumsum(fresh)[sorted_windows]
    at = order[sorted_windows]
    if not len(at):
        return []
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.repeat(np.minimum.reduceat(where[at], first), np.diff(np.append(first, len(group))))
    late = at[where[at] != least]
    docs = ranks[doc_rank[segment[late]]]
    starts = place[segment[late], 1] + offset[late]
    return list(zip(docs.tolist(), starts.tolist(), [1] * len(late)))


def _shard_pass(length: int):
    def run(table: pa.Table) -> pa.Table:
        held: dict = {}
        late: list[tuple] = []
        for pack in table.column("pack"):
            for _, doc, lo, n, text in _unpacked(pack.as_py()):
                _keep_first(held, text, doc, lo, n, late)
        rows = _merged(late + repeats(held, length))
        return pa.table({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("doc", "lo", "n"))})

    return run


def removed_bytes(size: int, windows: list[tuple], length: int) -> np.ndarray:
    step = np.zeros(size + 1, dtype=np.int64)
    for lo, n in windows:
        step[lo] += 1
        step[min(size, lo + n + length - 1)] -= 1
    return np.cumsum(step)[:size] > 0


def _cut_pass(length: int):
    def run(batches):
        for batch in batches:
            inflate = zstandard.ZstdDecompressor()
            out = []
            for packed, windows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = inflate.decompress(packed)
                kept, n_spans = text, 0
                if windows:
                    gone = removed_bytes(len(text), [(w["lo"], w["n"]) for w in windows], length)
                    n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), len(text) - len(kept), n_spans, kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return run


def _placed(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, doc, text); doc counts documents in the order of doc_id, and is doc_id unless ids repeat."""
    rows = documents.select("doc_id", F.col("doc_id").cast("long").alias("doc"), "text")
    if rows.where("doc is not null").groupBy("doc").count().where("count > 1").isEmpty():
        return rows
    mark = F.xxhash64("text")
    known = rows.where("doc is not null").select(F.col("doc").alias("id"), mark.alias("mark")).distinct()
    # sorted ranges are numbered one after the other, so the numbers rise with the order
    order = scratch.keep(known.orderBy("id", "mark").withColumn("place", F.monotonically_increasing_id()), "order")
    return rows.join(order, (F.col("doc") == F.col("id")) & (mark == F.col("mark")), "left").select("doc_id", F.col("place").alias("doc"), "text")


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES, fan: int = FAN
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "suffixes")
    kind = documents.schema["doc_id"].dataType.simpleString()
    every = _placed(documents, scratch)
    known = every.where("doc is not null").select("doc", "text")
    rows = scratch.keep(known.mapInArrow(_owner_pass(length, gram), "key long, doc long, run int, role byte, n long"), "owners")
    # rows of one key: at most one from each batch; the occurrences that a batch already saw twice need no count
    totals = scratch.keep(rows.where("role < 2").groupBy("key").agg(F.sum("n").alias("total")).where("total > 1"), "totals")
    firsts = rows.where("role < 2").join(totals, "key").select("doc", "run", (F.col("total") > hot).cast("int").alias("hot"))
    hot_keys = totals.where(F.col("total") > hot).select("key", F.lit(1).alias("hot"))
    hottest, further = hot_keys.count(), rows.where("role = 2")
    if hottest:
        further = further.join(F.broadcast(hot_keys) if hottest <= HOT_KEYS else hot_keys, "key", "left")
    further = further.select("doc", "run", F.coalesce("hot", F.lit(0)).alias("hot") if hottest else F.lit(0).alias("hot"))
    repeated = firsts.unionByName(further)
    per_doc = scratch.keep(
        repeated.groupBy("doc").agg(F.collect_list((F.col("run") * 2 + F.col("hot")).cast("int")).alias("runs")), "repeated"
    )
    volume = per_doc.agg(F.sum(F.size("runs"))).first()[0] or 0
    shards = max(1, int(volume * (length + length // 2) // (4 * shard_bytes)))
    fields = "doc long, packed binary, size long"
    packed = known.select(F.col("doc").alias("doc_id"), "doc", "text").mapInArrow(_pack, f"doc_id long, {fields}")
    met = packed.join(per_doc, "doc").select("doc", "packed", "runs", "size")
    kinds = "shard long, pack binary, doc long, lo long, n long"
    width = -(-shards // fan)
    found = scratch.keep(met.mapInArrow(_segment_pass(length, gram, shards, width), kinds), "segments")
    late = found.where("shard is null")
    while width > 1:
        # a bucket's packs go to as many tasks as finer packs it is dealt into
        width = -(-width // fan)
        dealt = found.where("shard is not null").repartition("shard", F.pmod(F.xxhash64("pack"), F.lit(fan))).mapInArrow(_deal_pass(width), kinds)
        found = scratch.keep(dealt, f"segments-{width}")
        late = late.unionByName(found.where("shard is null"))
    sorted_out = (
        found.where("shard is not null").select("shard", "pack").groupBy("shard").applyInArrow(_shard_pass(length), "doc long, lo long, n long")
    )
    late = late.select("doc", "lo", "n").unionByName(sorted_out)
    windows = late.groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("windows"))
    whole = every.mapInArrow(_pack, f"doc_id {kind}, {fields}")
    return (
        whole.join(windows, "doc", "left")
        .select("doc_id", "packed", "windows")
        .mapInArrow(
            _cut_pass(length),
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string",
        )
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
