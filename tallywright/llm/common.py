"""Shared plumbing: scratch tables in the shared folder, id-preserving batch
helpers and distributed connected components."""

from __future__ import annotations

import atexit
import gc
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests) a temporary folder of this
    machine is used and set as the checkpoint folder; on a cluster, whose
    executors would not see it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallywright-"))
    return context.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written once and read by several plans.

    A written table cuts the lineage: a lost executor costs a re-read of
    files in the shared folder, never a recomputation of the steps before.
    The folder goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tallywright-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone by now: the folder is the cluster's to clean
            pass


def release(spark: SparkSession) -> None:
    """Shuffle files of finished plans go once the driver's JVM has collected their handles; by itself it may not for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Shared:
    """A value for tasks, broadcast as bytes that carry its classes: workers need not have this package."""

    def __init__(self, spark: SparkSession, value):
        self._held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self._held.value)


def hashed_share(column, size: int, total: int, seed: int = 0) -> Column:
    """True for about ``size`` of ``total`` rows, by a hash: no task sends more than its part of them."""
    turn = F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return turn < min(1.0, size / max(1, total))


def least_of_top(counts: DataFrame, column: str, most: int):
    """The smallest count t for which at most ``most`` rows have t or more, or None where even the largest are too many.

    Read off a histogram in steps of 2^(1/16), so only a few hundred rows reach the driver.
    """
    step = F.floor(F.log2(column) * 16).alias("step")
    held, least = 0, None
    for _, n, low in sorted(counts.groupBy(step).agg(F.count("*"), F.min(column)).collect(), reverse=True):
        held += n
        if held > most:
            break
        least = low
    return least


def own_name(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column) -> list:
    """Values of an Arrow string column as bytes objects; null stays None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.to_pylist()


def portions(texts: list, limit: int = 2_000_000):
    """Consecutive (start, stop) ranges of about ``limit`` bytes of text."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Forest:
    """Union-find that remembers only parents."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node.

    Alternating large-star and small-star rounds. A hub's edges are met by a
    join (whose skew adaptive execution splits) with per-node minima that
    combine before the shuffle; no neighbour list is ever gathered. Each
    round is a written table.
    """

    def minima(links: DataFrame) -> DataFrame:
        return links.groupBy("u").agg(F.min("v").alias("m"))

    def star(links: DataFrame) -> DataFrame:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = minima(both).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")

    def inward(links: DataFrame) -> DataFrame:
        down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = minima(down)
        moved = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    def seal(links: DataFrame):
        row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    current = scratch.keep(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        f"{tag}-0",
    )
    before, turn = seal(current), 0
    while before[0]:
        turn += 1
        following = scratch.keep(inward(star(current)), f"{tag}-{turn}")
        after = seal(following)
        scratch.drop(f"{tag}-{turn - 1}")
        current = following
        if after == before:
            break
        before = after
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
