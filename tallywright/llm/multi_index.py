"""Embedding near-duplicates with an inverted multi-index.

Vectors are halved; each half has its own codebook, fitted by k-means on a
bounded sample (``SAMPLE`` distinct vectors, or ``PER_WORD`` for each word) of
each vector length. A vector lives in the cell (nearest word of the first
half, nearest word of the second); words grow with the square root of the
table, so cells keep about ``OCCUPANCY`` vectors up to ``WORDS`` words, a
thousand million vectors. A query walks cells in the order of a lower bound of
the squared distance to anything in them, by multi-sequence traversal of the
two sorted lists of half bounds, each the distance from a Voronoi cell.

The walk stops at a bound for the target recall. Of a pair at the threshold
whose difference has no preferred direction, the part along two given
directions exceeds that bound in one of 1 / (1 - ``TARGET``) cases; pairs
closer by do much more rarely. ``PROBES`` vectors are then compared with all
others, and the bound is raised to ``MARGIN`` times the largest bound at which
a linked one of theirs was met, up to the threshold's chord, where recall is 1
whatever the data. Candidates are verified by cosine in double precision.

Every vector is indexed and every vector is a query. Equal vectors are one
node with a number of copies. A pair from two cells is met once, in the later
cell; cells of more than ``BLOCK`` vectors are cut into blocks, which are
separate units of work. Cells of like words share a shard, so that a query
asks few of them. A shard returns, per vector, a sum of links and at most one
edge of a spanning forest; pairs are never emitted.

Edge cases: a null vector, one with null or non-finite components, an all-zero
or empty one links with nothing and is its own component; vectors of different
lengths never link; lengths of few vectors are one cell; repeated vectors link
with each other; rows whose vec_id is null link with nothing and have no
component; an empty table gives no rows; labels and other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import Forest, Scratch, Shared, connected_components, hashed_share

COSINE = 0.95
SAMPLE = 16_384
PER_WORD = 32
BLOCK = 4096
#: Vectors a cell should hold on average, and the most words of a codebook.
OCCUPANCY = 256
WORDS = 2048
SHARD = 16_384
#: Share of the pairs at the threshold to be met, vectors that check it, and what is added to what they show.
TARGET = 0.999
PROBES = 256
MARGIN = 2.0


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, against overflow."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def codebook(points: np.ndarray, words: int, turns: int = 12) -> np.ndarray:
    """k-means with deterministic spread-out starts."""
    start = [0]
    far = ((points - points[0]) ** 2).sum(axis=1)
    rng = np.random.default_rng(7)
    while len(start) < min(words, len(points)) and far.max() > 1e-12:
        start.append(int(rng.choice(len(points), p=far / far.sum())))
        far = np.minimum(far, ((points - points[start[-1]]) ** 2).sum(axis=1))
    centres = points[start].copy()
    for _ in range(turns):
        near = nearest(points, centres)[0]
        order = np.argsort(near, kind="stable")
        kinds, first = np.unique(near[order], return_index=True)
        centres[kinds] = np.add.reduceat(points[order], first, axis=0) / np.diff(np.append(first, len(near)))[:, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray):
    d = (points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)[None]
    return d.argmin(axis=1), np.maximum(d, 0)


class MultiIndex:
    """Codebooks of both halves for one vector length; words of a half that lie near each other form a group."""

    def __init__(self, sample: np.ndarray, words: int, groups: int = 1):
        self.cut = sample.shape[1] // 2
        halves = (sample[:, : self.cut], sample[:, self.cut :])
        self.books = [codebook(h, words) if h.shape[1] else np.zeros((1, 0)) for h in halves]
        self.gaps = [np.sqrt(np.maximum(nearest(b, b)[1], 1e-30)) for b in self.books]
        self.groups = [nearest(b, codebook(b, groups))[0] if b.shape[1] else np.zeros(1, dtype=np.int64) for b in self.books]

    def group(self, cell):
        """Of a cell or an array of cells."""
        first, second = np.divmod(cell, len(self.books[1]))
        return self.groups[0][first] * 65_537 + self.groups[1][second]

    def halves(self, vectors):
        return vectors[:, : self.cut], vectors[:, self.cut :]

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        first, second = (nearest(h, b)[0] for h, b in zip(self.halves(vectors), self.books))
        return first * len(self.books[1]) + second

    def bounds(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Squared lower bounds of the distance to each word's Voronoi cell, per half."""
        out = []
        for half, book, gap in zip(self.halves(vectors), self.books, self.gaps):
            near, d = nearest(half, book)
            own = d[np.arange(len(d)), near]
            beyond = (d - own[:, None]) / (2 * gap[near])
            beyond[np.arange(len(d)), near] = 0
            out.append(np.maximum(beyond - 1e-7, 0) ** 2)
        return out

    def visited(self, first: np.ndarray, second: np.ndarray, limit: float) -> list[int]:
        """Multi-sequence traversal: cells in order of the summed bounds, up to the limit."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        fa, fb = first[a].tolist(), second[b].tolist()
        width, out, heap, queued = len(fb), [], [(fa[0] + fb[0], 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound > limit:
                break
            out.append(int(a[i]) * width + int(b[j]))
            for step in ((i + 1, j), (i, j + 1)):
                if step not in queued and step[0] < len(fa) and step[1] < width:
                    queued.add(step)
                    heapq.heappush(heap, (fa[step[0]] + fb[step[1]], *step))
        return out


def _rows(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _by_size(batch, at: int):
    """(rows, vectors) of a batch for each vector length."""
    column = batch.column(at)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, _rows(column.take(pa.array(rows)))


def _assign_pass(held):
    def run(batches):
        books = held.value
        for batch in batches:
            size_of = np.zeros(batch.num_rows, dtype=np.int32)
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            group = np.zeros(batch.num_rows, dtype=np.int64)
            for size, rows, vectors in _by_size(batch, 0):
                size_of[rows] = size
                if size in books:
                    cell[rows] = found = books[size].assign(units(vectors))
                    group[rows] = books[size].group(found)
            yield pa.RecordBatch.from_arrays([pa.array(size_of), pa.array(cell), pa.array(group)], ["size", "cell", "group"])

    return run


def _probe_pass(held, probes, cosine: float):
    """The largest bound at which a probe meets one of its links, for each vector length of a batch."""

    def run(batches):
        books, asked = held.value, probes.value
        for batch in batches:
            sizes, worst = [], []
            for size, _, vectors in _by_size(batch, 0):
                if size in asked:
                    unit = units(vectors)
                    row, probe = np.nonzero(unit @ asked[size][0].T >= cosine)
                    if len(row):
                        first, second = np.divmod(books[size].assign(unit)[row], len(books[size].books[1]))
                        sizes.append(size)
                        worst.append(float((asked[size][1][0][probe, first] + asked[size][1][1][probe, second]).max()))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(worst, pa.float64())], ["size", "worst"])

    return run


def _route_pass(held, crowded, wide, shards: int, limits: dict):
    """A row for each shard that a vector lives in or must ask; asked are later cells and later blocks of its own."""

    def run(batches):
        books, crowds, widths = held.value, crowded.value, wide.value
        known: dict[int, int] = {}

        def spot(size, cell, part):
            return (size << 44) + (cell << 20) + part

        def shard_of(size, index, place):
            if (shard := known.get(place)) is None:
                cell, part = (place >> 20) & 0xFFFFFF, place & 0xFFFFF
                group = int(index.group(cell)) if index else 0
                turn = (cell * 2654435761 & 0xFFFFFFFF) * widths.get((size, group), 1) >> 32
                if len(known) > 500_000:
                    known.clear()
                known[place] = shard = (group + size * 31 + (part + turn) * 7919) % shards
            return shard

        for batch in batches:
            out: dict[str, list] = {"shard": [], "row": [], "home": [], "asks": []}
            reps = batch.column(1).to_pylist()
            for size, rows, vectors in _by_size(batch, 0):
                index, unit = books.get(size), units(vectors)
                cells = index.assign(unit) if index else np.zeros(len(rows), dtype=np.int64)
                bounds = index.bounds(unit) if index else None
                for k, row in enumerate(rows.tolist()):
                    cell = int(cells[k])
                    parts = crowds.get((size, cell), 1)
                    part = hash(reps[row]) * 2654435761 % 4294967296 * parts >> 32
                    home = spot(size, cell, part)
                    asks = [spot(size, cell, p) for p in range(part + 1, parts)]
                    if index:
                        for other in index.visited(bounds[0][k], bounds[1][k], limits[size]):
                            if other > cell:
                                asks += [spot(size, other, p) for p in range(crowds.get((size, other), 1))]
                    lives = shard_of(size, index, home)
                    by: dict[int, list] = {lives: []}
                    for ask in asks:
                        by.setdefault(shard_of(size, index, ask), []).append(ask)
                    for shard, asked in by.items():
                        out["shard"].append(shard)
                        out["row"].append(row)
                        out["home"].append(home if shard == lives else -1)
                        out["asks"].append(asked)
            rows = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["shard"], pa.int32()),
                    batch.column(1).take(rows),
                    batch.column(2).take(rows),
                    batch.column(0).take(rows),
                    pa.array(out["home"], pa.int64()),
                    pa.array(out["asks"], pa.list_(pa.int64())),
                ],
                ["shard", "rep", "copies", "embedding", "home", "asks"],
            )

    return run


def _verify_pass(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        reps, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        home = table.column("home").to_numpy()
        asks = table.column("asks").combine_chunks()
        ask_row = np.repeat(np.arange(len(reps)), asks.value_lengths().to_numpy(zero_copy_only=False))
        ask_unit = asks.flatten().to_numpy()
        order = np.argsort(ask_unit, kind="stable")
        ask_row, ask_unit = ask_row[order], ask_unit[order]
        links, forest = np.zeros(len(reps), dtype=np.int64), Forest(len(reps))
        vectors = table.column("embedding").combine_chunks()

        def compare(left, right, within):
            """Both ends of close pairs gain the other's copies; within: left and right are the same rows."""
            b = units(_rows(vectors.take(pa.array(right))))
            step = max(1, 2_000_000 // len(right))
            for at in range(0, len(left), step):
                rows = left[at : at + step]
                a = b[at : at + step] if within else units(_rows(vectors.take(pa.array(rows))))
                close = a @ b.T >= cosine
                if within:
                    close[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
                    links[rows] += close @ copies[right]
                else:
                    links[rows] += close @ copies[right]
                    links[right] += copies[rows] @ close
                # joining each row to its first match, and each match to its first row, keeps what is connected:
                # rows of one match set meet through it, the rest through the forest
                for i in np.flatnonzero(close.any(axis=1)):
                    root = forest.root(int(rows[i]))
                    hits = right[close[i]]
                    for j in hits[forest.parent[hits] != root].tolist():
                        forest.join(int(rows[i]), j)

        live = np.flatnonzero(home >= 0)
        live = live[np.argsort(home[live], kind="stable")]
        spots, first = np.unique(home[live], return_index=True)
        for spot, own in zip(spots, np.split(live, first[1:])):
            compare(own, own, True)
            lo, hi = np.searchsorted(ask_unit, [spot, spot + 1])
            if lo < hi:
                compare(ask_row[lo:hi], own, False)
        roots = np.array([forest.root(i) for i in range(len(reps))], dtype=np.int64)
        used = np.flatnonzero((links > 0) | (roots != np.arange(len(reps))))
        return pa.table({"rep": reps[used], "links": links[used], "root": reps[roots[used]]})

    return run


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK, occupancy: int = OCCUPANCY) -> DataFrame:
    """(vec_id, n_links, component_id, kept)."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "vectors")
    real = F.expr(
        "vec_id is not null and embedding is not null"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    distinct = scratch.keep(
        rows.where(real).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct"
    )
    sizes = {r[0]: r[1] for r in distinct.groupBy(F.size("embedding")).count().collect()}
    total = sum(sizes.values())
    shards = max(8, total // SHARD * 4)
    books, limits, probes, chord = {}, {}, {}, 2 - 2 * cosine + 1e-9
    for size, n in sorted(sizes.items()):
        words = max(1, min(WORDS, round(math.sqrt(n / occupancy))))
        if words == 1:
            continue
        own = distinct.where(F.size("embedding") == size)
        found = own.where(hashed_share("rep", max(SAMPLE, PER_WORD * words), n)).select("rep", "embedding").toArrow().sort_by("rep")
        sample = units(_rows(found.column(1).combine_chunks()))
        books[size] = index = MultiIndex(sample, words, math.isqrt(shards) + 1)
        limits[size] = min(chord, -2 * math.log(1 - TARGET) * chord / size)
        asked = sample[:: max(1, len(sample) // PROBES)]
        probes[size] = asked, index.bounds(asked)
    held = Shared(spark, books)
    if books:
        seen = distinct.select("embedding").mapInArrow(_probe_pass(held, Shared(spark, probes), cosine), "size int, worst double")
        for size, worst in seen.groupBy("size").agg(F.max("worst")).collect():
            limits[size] = min(chord, max(limits[size], MARGIN * worst))
    # at most words^2 cells for each vector length
    cells = scratch.keep(
        distinct.select("embedding").mapInArrow(_assign_pass(held), "size int, cell int, group long").groupBy("size", "cell", "group").count(), "cells"
    )
    # cells of like words go to one shard, unless they are too many vectors for one
    groups = cells.groupBy("size", "group").agg(F.sum("count").alias("n")).where(F.col("n") > SHARD // 4)
    wide = Shared(spark, {(r[0], r[1]): -(-r[2] // (SHARD // 4)) for r in groups.toLocalIterator()})
    crowds = {(r[0], r[1]): -(-r[3] // block) for r in cells.where(F.col("count") > block).toLocalIterator()}
    crowded = Shared(spark, crowds)
    kind = distinct.schema["embedding"].dataType.simpleString()
    routed = distinct.select("embedding", "rep", "copies").mapInArrow(
        _route_pass(held, crowded, wide, shards, limits),
        f"shard int, rep long, copies long, embedding {kind}, home long, asks array<long>",
    )
    found = scratch.keep(
        routed.groupBy("shard").applyInArrow(_verify_pass(cosine), "rep long, links long, root long"), "links"
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(spark, found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    known = (
        distinct.join(links, "rep", "left")
        .join(parts, distinct["rep"] == parts["node"], "left")
        .select(
            F.col("embedding").alias("shared"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    component = F.coalesce("component_id", "vec_id")
    return (
        rows.withColumn("shared_key", F.when(real, F.col("embedding")))
        .join(known, F.col("shared_key") == F.col("shared"), "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            (F.col("vec_id") == component).alias("kept"),
        )
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
