"""The exact part of SimHash near-dedup: Jaccard similarity of word-shingle sets.

A text's set holds the 64-bit hashes of its distinct ``SHINGLE``-word shingles.
Texts of equal sets are one node from the start. All sets are ordered alike,
rare shingles first. Two sets of similarity 4/5 or more then share a shingle
among the first n - ceil(4n/5) + 1 of each, so rows of (shingle, node) over
these prefixes meet every such pair; sizes and positions of the first common
shingle bound the overlap, and what is left is compared by its whole sets.
No pair is missed and none is linked unverified.

The order comes from shingle counts in a sample of an eighth of the documents,
``SAMPLE`` at least. Any order that all sets share gives the same links: the
sample only keeps common shingles out of the prefixes, also of large tables.

Whole sets move only for pairs that their bitmaps leave open. A bitmap has a
bit or two for each shingle of a set, the parity of those that fall on it. A bit
that differs takes a shingle that only one of the sets has, and sets of
similarity 4/5 differ in a ninth of both sizes at most: no such pair is lost.

Large groups: the close pairs that the fingerprint tree gives are settled
first. Shingles whose nodes it has brought into one component go no further.
A first round compares each node with the smallest node of each of its
shingles, unless the tree linked them. What it left in different components
and still shares a shingle is compared in a second one. Shingles of up to
``SMALL`` nodes give pairs, a bounded number a row. Nodes of more crowded
shingles are gathered into units (the components of those shingles); a unit is
cut into blocks, pairs of blocks are compared by tasks, in memory, and only a
spanning forest comes out: no pairs of a group are emitted. That is done once
with bitmaps, ``BLOCK`` words of them a block, and the components that these
leave are the units that are compared by whole sets.

Edge cases: null, empty and all-space texts have the empty set and are copies
of one another; a text of fewer words is one shingle; repeated rows share a
component; rows whose doc_id is null are left out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import Forest, Scratch, Shared, connected_components, hashed_share, least_of_top, release, utf8

SHINGLE = 5
SAMPLE = 20_000
#: One document in so many is sampled where that makes more of them.
SHARE = 8
#: Common shingles that are broadcast at most: 12 MB.
HOT = 1_000_000
#: Rows of (shingle, node) of a turn, and turns at most: each has its share of the shingles, so that one turn's shuffle is on disk at a time.
TURN, TURNS = 2_000_000, 4
HOT_LEAST = 3
SMALL = 64
BLOCK = 1_000_000
#: Ids that are broadcast at most: 8 MB.
FEW = 1_000_000
_P, _Q = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """word -> hash"""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def shingles(text: bytes | None, cache: Words, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 43)], dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - shingle + 1
    code = h[:n] * _P
    for k in range(1, shingle):
        code = (code ^ (code >> np.uint64(31))) * _Q + h[k : k + n]
    return np.unique((code ^ (code >> np.uint64(29))) * _P)


def set_key(codes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(codes.tobytes(), 7) if len(codes) else 0


def fingerprint(codes: np.ndarray) -> int:
    """A bit is set if more than half of the set's hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(codes), 65_536):
        ones += np.unpackbits(codes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(codes)).tobytes(), "big")


def bitmap(codes: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles over as many bits as it has shingles, rounded up to 64 times a power of two."""
    words = 1 << max(0, -(-len(codes) // 64) - 1).bit_length()
    bits = np.bincount((codes * _Q >> np.uint64(32)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps, one a row, over fewer bits: positions are taken modulo the smaller number."""
    while maps.shape[-1] > words:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def bitmap_links(maps: list[np.ndarray], sizes: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray):
    """(i, j) of a spanning forest over pairs of left and right nodes of different components that bitmaps leave open."""
    forest, out = Forest(len(maps)), []
    words = np.array([len(m) for m in maps])
    for w in np.unique(words[left]):
        mine = left[words[left] == w]
        for v in (w // 2, w, 2 * w):
            theirs = right[words[right] == v]
            if not len(theirs):
                continue
            theirs = theirs[np.argsort(sizes[theirs], kind="stable")]
            least = int(min(v, w))
            other, size = folded(np.stack([maps[j] for j in theirs]), least), sizes[theirs]
            lows, highs = np.searchsorted(size, 0.8 * sizes[mine] - 1), np.searchsorted(size, 1.25 * sizes[mine] + 1)
            for i, lo, hi in zip(mine.tolist(), lows.tolist(), highs.tolist()):
                differ = np.bitwise_count(other[lo:hi] ^ folded(maps[i], least)).sum(axis=1, dtype=np.int64)
                near = theirs[lo:hi][(9 * differ <= size[lo:hi] + sizes[i]) & (part[theirs[lo:hi]] != part[i])]
                for j in near.tolist():
                    if forest.root(i) != forest.root(j):
                        forest.join(i, j)
                        out.append((i, j))
    return out


def prefix(codes: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles in the common order, and how many of them come before those known to be common."""
    n = len(codes) - -(-4 * len(codes) // 5) + 1 if len(codes) else 0
    rank = np.zeros(len(codes), dtype=np.int64)
    if len(hot) and len(codes):
        at = np.minimum(np.searchsorted(hot, codes), len(hot) - 1)
        rank = np.where(hot[at] == codes, counts[at], 0)
    order = np.lexsort((codes, rank))[:n]
    return codes[order], int((rank[order] == 0).sum())


def _lists(arrays: list) -> pa.Array:
    edges = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.view(np.int64)))


def _slices(batches, rows: int = 1000):
    """Parts of batches, so that a worker holds the sets of few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _set_pass(shingle: int):
    def run(batches):
        cache = Words()
        for batch in _slices(batches):
            sets = [shingles(t, cache, shingle) for t in utf8(batch.column(0))]
            keys = np.array([set_key(s) for s in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), _lists(sets)], ["key", "codes"])

    return run


def _prefix_pass(held, shingle: int):
    def run(batches):
        cache, (hot, counts) = Words(), held.value
        for batch in _slices(batches):
            sets = [shingles(t, cache, shingle) for t in utf8(batch.column(1))]
            keys = np.array([set_key(s) for s in sets], dtype=np.uint64)
            firsts = [prefix(s, hot, counts) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(keys.view(np.int64)),
                    pa.array(np.array([len(s) for s in sets], dtype=np.int32)),
                    _lists([p for p, _ in firsts]),
                    pa.array(np.array([n for _, n in firsts], dtype=np.int32)),
                    pa.array(np.array([fingerprint(s) for s in sets], dtype=np.uint64).view(np.int64)),
                    _lists([bitmap(s) for s in sets]),
                ],
                ["doc_id", "key", "size", "prefix", "rare", "fp", "map"],
            )

    return run


def _common(named: DataFrame, shingle: int, sample: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Up to HOT shingles that several sampled documents hold, sorted, with their counts."""
    total = named.count()
    chosen = named.where(hashed_share("doc_id", max(sample, total // SHARE) if sample else 0, total)).select("text")
    codes = chosen.mapInArrow(_set_pass(shingle), "key long, codes array<long>").select(F.explode("codes").alias("code"))
    found = scratch.keep(codes.groupBy("code").count().where(F.col("count") >= HOT_LEAST), "common")
    found = found.where(F.col("count") >= (least_of_top(found, "count", HOT) or HOT_LEAST)).toArrow()
    hot, counts = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy().astype(np.int32)
    order = np.argsort(hot)
    return hot[order], counts[order]


def unit_links(sets: list[np.ndarray], part: np.ndarray, left: np.ndarray, right: np.ndarray):
    """(i, j) of a spanning forest over links between left and right nodes whose components differ.

    Overlaps are counted by postings: a node's shingles name the right nodes that hold them.
    """
    if not len(left) or not len(right):
        return []
    codes = np.concatenate([sets[i] for i in right])
    owner = np.repeat(right, [len(sets[i]) for i in right])
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    sizes = np.array([len(s) for s in sets])
    _, label = np.unique(part, return_inverse=True)
    forest, out = Forest(int(label.max()) + 1), []
    for i in left.tolist():
        lo, hi = np.searchsorted(codes, sets[i]), np.searchsorted(codes, sets[i], side="right")
        n = hi - lo
        met = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        both = np.bincount(met, minlength=len(sets))
        close = np.flatnonzero(9 * both >= 4 * (sizes + sizes[i]))
        for j in close[both[close] > 0].tolist():
            if forest.root(int(label[i])) != forest.root(int(label[j])):
                forest.join(int(label[i]), int(label[j]))
                out.append((i, j))
    return out


def _unit_pass(compare):
    """Links of every (unit, block pair) of a shard; rows (unit, block, first, second, key, size, part, codes)."""

    def run(table: pa.Table) -> pa.Table:
        return _unit_table(table, compare)

    return run


def _by_bitmaps(maps, sizes, part, left, right):
    return bitmap_links(maps, sizes, part, left, right)


def _by_sets(sets, sizes, part, left, right):
    return unit_links(sets, part, left, right)


def _unit_table(table: pa.Table, compare) -> pa.Table:
    table = table.combine_chunks()
    unit, block, first, second, key, size, part = (table.column(c).to_numpy() for c in ("unit", "block", "first", "second", "key", "size", "part"))
    codes = table.column("codes")
    order = np.lexsort((key, second, first, unit))
    name = np.stack([unit, first, second])[:, order]
    cuts = np.flatnonzero(np.append(True, (name[:, 1:] != name[:, :-1]).any(axis=0)))
    a, b = [], []
    for rows in np.split(order, cuts[1:]):
        sets = [np.array(codes[int(r)].values.to_numpy()).view(np.uint64) for r in rows]
        mine, theirs = (np.flatnonzero(block[rows] == side[rows]) for side in (first, second))
        for i, j in compare(sets, size[rows].astype(np.int64), part[rows], mine, theirs):
            a.append(int(key[rows[i]]))
            b.append(int(key[rows[j]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _open_pairs(batches):
    """(a, na, b, nb) of the pairs whose bitmaps leave them open."""
    for batch in batches:
        a, na, b, nb = (batch.column(c) for c in ("a", "na", "b", "nb"))
        most = na.to_numpy().astype(np.int64) + nb.to_numpy()
        left, right = (batch.column(c) for c in ("ma", "mb"))
        keep = np.zeros(batch.num_rows, dtype=bool)
        for k in range(batch.num_rows):
            x, y = (np.array(m[k].values.to_numpy()).view(np.uint64) for m in (left, right))
            words = min(len(x), len(y))
            keep[k] = 9 * int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= most[k]
        yield pa.RecordBatch.from_arrays([a, na, b, nb], ["a", "na", "b", "nb"]).filter(pa.array(keep))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, sample: int = SAMPLE, close=None, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id that links of similarity 4/5 or more reach.

    ``close`` makes pairs of keys that are worth a look, (a, b), of (key, fp), the sets' fingerprints.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "shingles")
    kind = documents.schema["doc_id"].dataType.simpleString()
    named = documents.where("doc_id is not null").select("doc_id", "text")
    held = Shared(spark, _common(named, shingle, sample, scratch))
    release(spark)
    prints = scratch.keep(
        named.mapInArrow(_prefix_pass(held, shingle), f"doc_id {kind}, key long, size int, prefix array<long>, rare int, fp long, map array<long>"), "prints"
    )
    # rows of equal keys have equal sizes, fingerprints and bitmaps
    firsts = scratch.keep(prints.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.min("fp").alias("fp")), "firsts")

    def few_or_joined(keys: DataFrame) -> DataFrame:
        """Few ids go to the rows; only where they are many do the rows move."""
        return F.broadcast(keys) if keys.count() <= FEW else keys

    def texts_of(keys: DataFrame, name: str) -> DataFrame:
        """(key, codes) of the named sets, made again from one text of each."""
        owners = scratch.keep(keys.distinct().join(firsts, "key").select("rep").distinct(), f"{name}-owners")
        texts = named.join(few_or_joined(owners), F.col("doc_id") == F.col("rep")).select("text")
        # where ids repeat, other texts may come along or a text twice: neither meets a pair that it should not
        return scratch.keep(texts.mapInArrow(_set_pass(shingle), "key long, codes array<long>"), f"{name}-sets")

    def maps_of(keys: DataFrame, name: str) -> DataFrame:
        """(key, map) of the named sets."""
        named_keys = scratch.keep(keys.distinct(), f"{name}-keys")
        found = prints.join(few_or_joined(named_keys), "key").join(firsts.select(F.col("key").alias("own"), "rep"), (F.col("key") == F.col("own")) & (F.col("doc_id") == F.col("rep")))
        return scratch.keep(found.select("key", "map").dropDuplicates(["key"]), f"{name}-maps")

    def keys_of(fit: DataFrame) -> DataFrame:
        return fit.select(F.explode(F.array("a", "b")).alias("key"))

    def fitting(pairs: DataFrame, name: str) -> DataFrame:
        """The distinct pairs that sizes and bitmaps leave open."""
        fit = scratch.keep(pairs.where(9 * F.least("na", "nb") >= 4 * (F.col("na") + F.col("nb"))).distinct(), f"{name}-sized")
        maps = maps_of(keys_of(fit), name)
        both = fit.join(maps.toDF("a", "ma"), "a").join(maps.toDF("b", "mb"), "b")
        out = scratch.keep(both.mapInArrow(_open_pairs, "a long, na int, b long, nb int"), f"{name}-fit")
        for piece in ("sized", "keys", "maps"):
            scratch.drop(f"{name}-{piece}")
        release(spark)
        return out

    def linked(fit: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """Verified (a, b) of fit(a, na, b, nb)."""
        least = 4 * (F.col("na") + F.col("nb"))
        left, right = sets.select(F.col("key").alias("a"), F.col("codes").alias("sa")), sets.select(F.col("key").alias("b"), F.col("codes").alias("sb"))
        both = fit.join(left, "a").join(right, "b").where(9 * F.size(F.array_intersect("sa", "sb")) >= least)
        return scratch.keep(both.select("a", "b").distinct(), name)

    def settled(pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs; what was made on the way is dropped."""
        fit = fitting(pairs, name)
        out = linked(fit, texts_of(keys_of(fit), name), name)
        for piece in ("fit", "owners", "sets"):
            scratch.drop(f"{name}-{piece}")
        release(spark)
        return out

    def reaching(pairs: DataFrame) -> DataFrame:
        """(a, na, b, nb) of pairs whose sizes and places leave room for the overlap."""
        reach = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
        return pairs.where(9 * reach >= 4 * (F.col("na") + F.col("nb"))).select("a", "na", "b", "nb")

    one = lambda x, p="": [F.col(f"{p}key").alias(x), F.col(f"{p}size").alias(f"n{x}"), F.col(f"{p}at").alias(f"i{x}")]
    tree = None
    placed = prints.select("key", "size", "rare", "prefix", F.col("key").alias("part"))
    if close is not None:
        size = firsts.select("key", "size")
        near = close(firsts.select("key", "fp")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tree = settled(near.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "na", "b", "nb"), "tree")
        trees = few_or_joined(scratch.keep(connected_components(spark, tree, scratch, "cc0"), "trees"))
        placed = placed.drop("part").join(trees, F.col("key") == F.col("node"), "left").select("key", "size", "rare", "prefix", F.coalesce("component", "key").alias("part"))
    placed = placed.select("key", "part", "size", "rare", F.posexplode("prefix").alias("at", "code"))
    # the smallest node of a shingle stands for it. A shingle that the sample doesn't know as common is held by few:
    # one shuffle brings its rows together, and copies (rows of equal keys have equal prefixes) drop out where they lie.
    # Common ones may be held by very many: minima combine before the shuffle, and the join back can be split.
    hub, low, high = F.min(F.struct("key", "size", "at", "part")), F.min("part"), F.max("part")
    columns = ["code", "key", "part", "size", "at"]
    same = Window.partitionBy("code").orderBy("key")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (prints.agg(F.sum("size")).first()[0] or 0) // 5
    turns = min(TURNS, 1 + rows // TURN)

    def shared_of(placed: DataFrame) -> DataFrame:
        """Rows of the shingles whose nodes lie in several components of the tree's links."""
        few = placed.where("at < rare").select(*columns).withColumns({"hub": hub.over(whole), "low": low.over(whole), "high": high.over(whole), "previous": F.lag("key").over(same)})
        few = few.where("low <> high and (previous is null or previous <> key)")
        common = placed.where("at >= rare").select(*columns)
        hubs = common.groupBy("code").agg(hub.alias("hub"), low.alias("low"), high.alias("high")).where("low <> high").select("code", "hub")
        return few.select(*columns, "hub").unionByName(common.join(hubs, "code").select(*columns, "hub").dropDuplicates(["code", "key"]))

    def together(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for more in tables[1:]:
            out = out.unionByName(more)
        return out

    portions = []
    for turn in range(turns):
        portions.append(scratch.keep(shared_of(placed.where(F.pmod("code", F.lit(turns)) == turn)), f"shared-{turn}"))
        release(spark)
    shared = together(portions)

    first = settled(reaching(shared.where("hub.key <> key and hub.part <> part").select(*one("a", "hub."), *one("b"))), "first")
    if tree is not None:
        first = first.unionByName(tree)
    parts = few_or_joined(scratch.keep(connected_components(spark, first, scratch, "cc1"), "parts"))
    for turn, portion in enumerate(portions):
        part = scratch.keep(
            portion.drop("part").join(parts, F.col("key") == F.col("node"), "left").select("code", "key", "size", "at", F.coalesce("component", "key").alias("part")), "part"
        )
        scratch.drop(f"shared-{turn}")
        # only shingles whose nodes lie in several components still hold pairs
        open_ = part.groupBy("code").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n"), F.min("key").alias("hub")).where("lo <> hi")
        portions[turn] = scratch.keep(part.join(open_.select("code", "n", "hub"), "code"), f"open-{turn}")
        scratch.drop("part")
        release(spark)
    left = together(portions)
    crowds = connected_components(spark, left.where((F.col("n") > small) & (F.col("key") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("key").alias("b")), scratch, "cc2")
    crowds = scratch.keep(crowds.select(F.col("node").alias("key"), F.col("component").alias("unit")), "crowds")
    sparse = scratch.keep(left.where(F.col("n") <= small).join(crowds, "key", "left"), "sparse")
    members = scratch.keep(left.select("key", "size", "part").distinct().join(crowds, "key"), "members")
    for turn in range(turns):
        scratch.drop(f"open-{turn}")
    x = sparse.select("code", F.col("part").alias("pa"), F.col("unit").alias("ua"), *one("a"))
    y = sparse.select("code", F.col("part").alias("pb"), F.col("unit").alias("ub"), *one("b"))
    second = settled(reaching(x.join(y, "code").where("a < b and pa <> pb and not coalesce(ua = ub, false)")), "second")

    def compared(member: DataFrame, sets: DataFrame, words: str, compare, name: str) -> DataFrame:
        """Forest links (a, b) of the nodes (key, size, part) of each unit, by what sets(key, codes) holds of them."""
        volume = member.groupBy("unit").agg((F.floor(F.sum(F.expr(words)) / block) + 1).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
        dealt = member.join(volume, "unit").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sides = dealt.select("unit", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "key", "size", "part")
        shards = max(1, int((member.agg(F.sum(F.expr(words))).first()[0] or 0) // block) * 4)
        shard = F.pmod(F.xxhash64("unit", "first", "second"), F.lit(shards)).alias("shard")
        rows = sides.join(sets, "key").select(shard, "unit", "block", "first", "second", "key", "size", "part", "codes")
        return scratch.keep(rows.groupBy("shard").applyInArrow(_unit_pass(compare), "a long, b long"), name)

    maps = maps_of(members.select("key"), "units").toDF("key", "codes")
    # 16 and not 64: a bitmap has up to two bits a shingle, and its node a row of other columns
    alike = compared(members, maps, "2 + size / 16", _by_bitmaps, "alike")
    scratch.drop("units-maps")
    release(spark)
    units = scratch.keep(connected_components(spark, alike, scratch, "cc3").select(F.col("node").alias("key"), F.col("component").alias("unit")), "units")
    member = scratch.keep(members.drop("unit").join(units, "key"), "member")
    third = compared(member, texts_of(member.select("key"), "third"), "size", _by_sets, "third")
    scratch.drop("third-sets")
    release(spark)
    joined = connected_components(spark, first.unionByName(second).unionByName(third), scratch, "cc4")
    owner = firsts.join(joined, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "key").alias("part"))
    least = owner.groupBy("part").agg(F.min("rep").alias("component_id"))
    return prints.select("doc_id", "key").join(owner.join(least, "part").select("key", "component_id"), "key").select("doc_id", "component_id")
