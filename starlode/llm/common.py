"""Shared folders, written intermediate tables and connected components."""

from __future__ import annotations

import atexit
import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import shared_folder

_made: list[tuple[SparkSession, str]] = []


def labels(spark: SparkSession) -> list[int]:
    """For each partition of a shuffle a number (an int column's value) that Spark's hash partitioning sends there."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    out, found, at = np.arange(n), np.zeros(n, bool), 0
    while not found.all():
        i = np.arange(at, at + 16 * n + 64, dtype=np.uint32)
        to = hash_of(i).view(np.int32).astype(np.int64) % n
        out[to[::-1]], found[to] = np.where(found[to[::-1]], out[to[::-1]], i[::-1].astype(np.int64)), True
        at += len(i)
    return out.tolist()


def hash_of(x: np.ndarray) -> np.ndarray:
    """Spark's hash of an int: MurmurHash3 of its four bytes, seed 42."""

    def turn(v, r):
        return (v << np.uint32(r)) | (v >> np.uint32(32 - r))

    k = turn(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def settle(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps at once; they would stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Intermediate tables, written to the shared folder: they cut the lineage and outlive executors.

    ``drop`` deletes one as soon as nothing reads it any more; what is left goes when the
    driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _made.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session has ended before
            return


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a, b): (node, root), root being the smallest node reachable.

    Alternates large-star and small-star steps until all edges lead from a node with no
    other edge to its root. A step
    is a minimum per node (combined before its shuffle) and a join that AQE may split, so
    a node with very many edges doesn't end up in one task. Nodes without edges, null
    ends and loops have no row.
    """

    def distinct(df: DataFrame) -> DataFrame:
        return df.where("a <> b").distinct()

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        return distinct(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least))

    def stars(e: DataFrame) -> bool:
        """Whether every a has one b, and no b is an a."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").limit(1).count()

    now = scratch.keep(small(distinct(edges.select("a", "b"))), f"{name}0")
    step = 0
    while not stars(now):
        step += 1
        after = scratch.keep(small(large(now)), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


class Forest:
    """Union-find over the integers below n, for one task's members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
