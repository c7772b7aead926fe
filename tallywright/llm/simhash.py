"""SimHash near-duplicates found with vantage-point trees.

A fingerprint has 64 bits, from the XXH64 (seed 42) of a text's word shingles,
repeats included. Equal fingerprints are one node from the start, so groups
of exact copies never meet each other. Distinct fingerprints are cut into
shards by the upper levels of a vantage-point tree. Its vantage points and
radii come from samples of about ``SAMPLE`` fingerprints: one of all, then, as
long as a leaf stands for more than ``SHARD`` rows, one of each such leaf,
planted by the tasks; the tree that is broadcast has one leaf for about
``SHARD`` fingerprints. Every fingerprint is routed and indexed. At each branch the triangle
inequality tells which sides a ball of radius ``distance`` can touch: only
those shards are queried, with one copy of the row each, and a pair that
straddles a boundary is met from its inner side. Each shard repeats the same
division in memory until its parts are small, compares what is left exactly,
and hands on a spanning forest of its links, at most one edge per row. The
components of all edges follow from distributed star rounds.

``similar_documents`` links by the Jaccard similarity of five-word shingle
sets, 4/5 or more, in place of a number of bits. At that similarity
fingerprints are expected to differ in ten bits, a radius at which a tree over
64 bits no longer divides. The tree therefore gives the close pairs, which
whole sets confirm, and ``shingle_join`` finds the rest exactly: shingles
whose nodes the tree's links bring together go no further.

Edge cases: null, empty and all-space texts have fingerprint zero and link
like others; a text of one or two words is one shingle; repeated rows share a
component; a row whose doc_id is null has no component and links nothing; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import shingle_join
from tallywright.llm.common import Forest, Scratch, Shared, connected_components, hashed_share, utf8

SHINGLE = 3
DISTANCE = 2
SAMPLE = 8192
SHARD = 32_768
LEAF = 96
#: Sampled points that a leaf needs to be divided.
LEAST = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, 42) for p in parts), dtype=">u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return run


def distances(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def divide(points: np.ndarray, reach: int):
    """The vantage point and radius that send the fewest queries to both sides, or None where nothing splits."""
    tried = points[:: max(1, len(points) // 24)][:24]
    best = None
    for vantage in tried:
        d = distances(points, vantage)
        radius = int(np.partition(d, len(d) // 2)[len(d) // 2])
        for mu in {radius - 1, radius}:
            inside = int((d <= mu).sum())
            small = min(inside, len(d) - inside)
            if small < len(d) // 8 or small == 0:
                continue
            both = int(((d > mu - reach) & (d <= mu + reach)).sum())
            if best is None or both < best[0]:
                best = (both, int(vantage), mu)
    return best[1:] if best else None


def plant(sample: np.ndarray, weight: float, reach: int):
    """Upper tree: ("leaf",) or (vantage, mu, inside, outside). A sampled point stands for ``weight`` rows; leaves of a shard's size or of few points stay."""
    if len(sample) < LEAST or len(sample) * weight <= SHARD:
        return ("leaf",)
    cut = divide(sample, reach)
    if cut is None:
        return ("leaf",)
    inside = distances(sample, cut[0]) <= cut[1]
    return (*cut, plant(sample[inside], weight, reach), plant(sample[~inside], weight, reach))


def leaves(tree) -> int:
    return 1 if tree[0] == "leaf" else leaves(tree[2]) + leaves(tree[3])


def grafted(tree, grown: dict, at: int = 0):
    """(tree, next leaf) with the numbered leaves replaced by what grew there."""
    if tree[0] == "leaf":
        return grown.get(at, tree), at + 1
    inner, at = grafted(tree[2], grown, at)
    outer, at = grafted(tree[3], grown, at)
    return (*tree[:2], inner, outer), at


def route(tree, points: np.ndarray, reach: int):
    """(shard, row, home) for each row's own shard and for the shards that it queries."""
    out, leaves = [], [0]

    def down(node, home, query):
        if node[0] == "leaf":
            out.append((leaves[0], home, query))
            leaves[0] += 1
            return
        vantage, mu, inner, outer = node
        dh, dq = distances(points[home], vantage), distances(points[query], vantage)
        inside = dh <= mu
        down(inner, home[inside], query[dq - reach <= mu])
        # a pair across the boundary is met once: its inner point asks the outer side
        across = home[inside & (dh + reach > mu)]
        down(outer, home[~inside], np.concatenate([query[dq + reach > mu], across]))

    rows = np.arange(len(points))
    down(tree, rows, rows[:0])
    return out


def _homes(held):
    def run(batches):
        tree = held.value
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, home, _ in route(tree, points, -1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(home), shard, dtype=np.int32)), pa.array(points[home].view(np.int64))], ["shard", "fp"])

    return run


def _plant_pass(weight: float, reach: int):
    def run(table: pa.Table) -> pa.Table:
        points = np.sort(table.column("fp").to_numpy().view(np.uint64))
        # sorted and then spread, so that the candidates of a cut are any of them and the same in every run
        spread = points[np.argsort(points * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
        return pa.table({"shard": [table.column("shard")[0].as_py()], "tree": [pickle.dumps(plant(spread, weight, reach))]}, schema=_GROWN)

    return run


_GROWN = pa.schema([("shard", pa.int32()), ("tree", pa.binary())])


def upper_tree(points: DataFrame, total: int, reach: int):
    """A tree whose leaves stand for about SHARD of the ``total`` distinct fingerprints; each turn divides its large leaves."""
    tree, size = ("leaf",), 0
    while size < total and total > SHARD:
        before = leaves(tree)
        size = SAMPLE * before
        held = Shared(points.sparkSession, tree)
        sample = points.select("fp").where(hashed_share("fp", size, total, before)).mapInArrow(_homes(held), "shard int, fp long")
        grown = sample.groupBy("shard").applyInArrow(_plant_pass(max(1.0, total / size), reach), "shard int, tree binary").collect()
        tree, _ = grafted(tree, {r[0]: pickle.loads(r[1]) for r in grown})
        if leaves(tree) == before:
            break
    return tree


def _route(held, reach: int):
    def run(batches):
        tree = held.value
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            reps = batch.column(1).to_numpy(zero_copy_only=False)
            for shard, home, query in route(tree, points, reach):
                rows = np.concatenate([home, query])
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), shard, dtype=np.int32)),
                            pa.array(points[rows].view(np.int64)),
                            pa.array(reps[rows]),
                            pa.array(np.arange(len(rows)) < len(home)),
                        ],
                        ["shard", "fp", "rep", "home"],
                    )

    return run


def linked(points: np.ndarray, home: np.ndarray, reach: int, on_pairs) -> None:
    """Calls on_pairs(left rows, right rows) with every pair within reach that has a home row on the right side."""

    def compare(left: np.ndarray, right: np.ndarray) -> None:
        step = max(1, 4_000_000 // max(1, len(right)))
        for at in range(0, len(left), step):
            close = np.bitwise_count(points[left[at : at + step], None] ^ points[None, right]) <= reach
            a, b = np.nonzero(close)
            if len(a):
                on_pairs(left[at + a], right[b])

    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        own, query = stack.pop()
        if not len(own) or len(own) + len(query) < 2:
            continue
        cut = divide(points[own[:: max(1, len(own) // 512)]], reach) if len(own) > LEAF else None
        if cut is None:
            compare(own, own)
            compare(query, own)
            continue
        dh, dq = distances(points[own], cut[0]), distances(points[query], cut[0])
        inside = dh <= cut[1]
        stack.append((own[inside], query[dq - reach <= cut[1]]))
        stack.append((own[~inside], np.concatenate([query[dq + reach > cut[1]], own[inside & (dh + reach > cut[1])]])))


def _shard_links(reach: int):
    def run(table: pa.Table) -> pa.Table:
        points = table.column("fp").to_numpy().view(np.uint64)
        reps, home = table.column("rep").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        forest = Forest(len(points))

        def unite(left, right):
            fresh = left != right
            for a, b in zip(left[fresh].tolist(), right[fresh].tolist()):
                forest.join(a, b)

        linked(points, home, reach, unite)
        roots = np.array([forest.root(i) for i in range(len(points))], dtype=np.int64)
        member = np.flatnonzero(roots != np.arange(len(points)))
        return pa.table({"a": reps[member], "b": reps[roots[member]]})

    return run


def close_edges(distinct: DataFrame, distance: int) -> DataFrame:
    """Spanning edges (a, b) between the ``rep`` of fingerprints of ``distinct(fp, rep)`` that differ in so many bits or fewer."""
    held = Shared(distinct.sparkSession, upper_tree(distinct, distinct.count(), distance))
    routed = distinct.select("fp", "rep").mapInArrow(_route(held, distance), "shard int, fp long, rep long, home boolean")
    return routed.groupBy("shard").applyInArrow(_shard_links(distance), "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "simhash")
    kind = documents.schema["doc_id"].dataType.simpleString()
    prints = scratch.keep(
        documents.select("doc_id", "text").mapInArrow(_fingerprints(shingle), f"doc_id {kind}, fp long"), "prints"
    )
    distinct = scratch.keep(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")), "distinct")
    parts = connected_components(spark, close_edges(distinct, distance), scratch)
    labelled = distinct.join(parts, distinct["rep"] == parts["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return prints.join(labelled, "fp", "left").select("doc_id", "fp", component)


def similar_documents(documents: DataFrame, shingle: int = 5, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, component_id) by links of Jaccard similarity 4/5 or more; rows whose doc_id is null are left out."""
    scratch = Scratch(documents.sparkSession, "similar")

    def close(prints: DataFrame) -> DataFrame:
        distinct = scratch.keep(prints.groupBy("fp").agg(F.min("key").alias("rep")), "distinct")
        equal = prints.join(distinct, "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
        return equal.unionByName(close_edges(distinct, distance))

    return shingle_join.near_duplicates(documents, shingle, close=close)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
