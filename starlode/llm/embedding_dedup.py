"""Embedding near-dedup by spherical-cap filters.

Vectors with one label and equal components are one class. Filters are directions of a
product code: the dimensions are split into two blocks, each with random codewords, and a
filter is a pair of codewords. A vector is decoded to all filters whose cap it lies in
(inner product above a threshold); classes that share a label and a filter are compared by
cosine in double precision. A pair is counted in the first of the filters that it shares.

The number of codewords follows the largest label's number of classes so that a filter's
share of them stays small, and the threshold follows from it: a vector has as many filters
as make ``shared`` common ones likely for a pair at the least cosine. A vector that lies
in fewer caps than the average is decoded to that many nearest filters, so sparse regions
of the code lose no links. Filters with more
classes than ``block`` are compared block against block.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, Scratch, components


@dataclass(frozen=True)
class Settings:
    """cosine: the least of a link. shared: common filters that a pair at that cosine has on average. cell: classes of a label in a filter for each filter of a class."""

    cosine: float = 0.93
    shared: float = 9.0
    cell: float = 2.0
    least_words: int = 64
    block: int = 512
    seed: int = 11


def sharing(z: float, cosine: float) -> float:
    """The probability that a vector lies in a cap of height z (in standard deviations), given that one at the cosine does."""
    normal = NormalDist()
    xs = np.linspace(z, z + 6, 600)
    weight = np.exp(-xs * xs / 2)
    tail = np.array([1 - normal.cdf((z - cosine * x) / math.sqrt(1 - cosine * cosine)) for x in xs])
    return float((weight * tail).sum() / weight.sum())


def design(classes: int, s: Settings) -> tuple[int, float, int]:
    """Codewords of a block, the height of the caps in standard deviations and the filters of a vector on average."""
    words = max(s.least_words, math.isqrt(max(int(classes / s.cell), 1)) + 1)
    many = s.shared * 2
    for _ in range(20):
        z = NormalDist().inv_cdf(1 - many / words**2)
        many = s.shared / sharing(z, s.cosine)
    return words, z, math.ceil(many)


def codewords(dim: int, words: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed + dim)
    out = []
    for size in (dim - dim // 2, dim // 2):
        c = rng.standard_normal((words, size))
        out.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) if size else c)
    return out[0], out[1]


def decode(unit: np.ndarray, words: int, z: float, least: int, s: Settings) -> list[np.ndarray]:
    """The numbers (ascending) of all filters in whose caps each unit vector lies, the ``least`` nearest ones included.

    The nearest pairs are among the nearest codewords of each block; codewords of the first
    block that can't reach the threshold with any of the second are left out before pairs
    are tried.
    """
    dim = unit.shape[1]
    a, b = codewords(dim, words, s)
    left, right = unit[:, : a.shape[1]] @ a.T, unit[:, a.shape[1] :] @ b.T
    least = min(least, words * words)
    few = min(least, words)
    top_l, top_r = (-np.partition(-side, few - 1, axis=1)[:, :few] for side in (left, right))
    sums = (top_l[:, :, None] + top_r[:, None, :]).reshape(len(unit), -1)
    need = np.minimum(z * math.sqrt(2 / dim), -np.partition(-sums, least - 1, axis=1)[:, least - 1] - 1e-12)
    best = right.max(axis=1)
    out = []
    for i in range(len(unit)):
        rows = np.flatnonzero(left[i] + best[i] >= need[i])
        x, y = np.nonzero(left[i][rows, None] + right[i][None, :] >= need[i])
        out.append(rows[x] * words + y)
    return out


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, key, vec): vec, the components as they came (4 or 8 bytes each), is null for vectors that link with nothing; key is its digest."""

    def run(batches):
        for batch in batches:
            data, item = [], "<f4" if pa.types.is_float32(batch.column(2).type.value_type) else "<f8"
            for v in batch.column(2).to_pylist():
                ok = v is not None and len(v) > 0 and None not in v
                x = np.array(v, np.float64) if ok else None
                data.append(x.astype(item).tobytes() if ok and np.isfinite(x).all() and x.any() else None)
            label = batch.column(1).is_valid().to_pylist()
            known = batch.column(0).is_valid().to_pylist()
            data = [d if on and id_ else None for d, on, id_ in zip(data, label, known)]
            key = [hashlib.blake2b(d, digest_size=16).digest() if d is not None else None for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(d) // int(item[2]) if d else 0 for d in data], pa.int32()), pa.array(key, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "label", "dim", "key", "vec"])

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, "vec_id long, label long, dim int, key binary, vec binary")


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, "<f8" if len(raw) == 8 * dim * len(column) else "<f4").astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def filtered(classes: DataFrame, s: Settings) -> DataFrame:
    """``classes`` (rep, label, dim, n, vec) with their ``filters``."""
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    words, z, least = design(int(largest), s)

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            filters: list = [None] * batch.num_rows
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), 1024):
                    part = at[i : i + 1024]
                    for k, f in zip(part, decode(unit_rows(batch.column(4).take(pa.array(part)), int(dim)), words, z, least, s)):
                        filters[k] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(filters, pa.list_(pa.int32()))], [*batch.schema.names, "filters"])

    return classes.select("rep", "label", "dim", "n", "vec").mapInArrow(run, "rep long, label long, dim int, n long, vec binary, filters array<int>")


def compared(cells: DataFrame, s: Settings) -> DataFrame:
    """(rep, links, root): for each class and cell in which it links, how many vectors, and a class that it connects to."""
    one = cells.select("label", "dim", F.explode("filters").alias("filter"))
    large = one.groupBy("label", "dim", "filter").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks")).where("blocks > 1")
    rows = cells.withColumn("filter", F.explode("filters")).join(large, ["label", "dim", "filter"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    # Blocks i <= j meet in cell (i, j): a class goes to the cells that hold its block.
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    rows = rows.select("label", "dim", "filter", "i", "j", "own", "rep", "n", "vec", "filters").repartition("label", "dim", "filter", "i", "j")

    def links(dim, filter_, i, j, own, rep, n, vec, filters):
        """Counts and connects the pairs of a cell whose first common filter this is."""
        x = unit_rows(vec, dim)
        order = np.argsort(own, kind="stable")
        first = order[own[order] == i]
        second = first if i == j else order[own[order] == j]
        close = x[first] @ x[second].T >= s.cosine
        if i == j:
            np.fill_diagonal(close, False)
        if not close.any():
            return
        earlier = [f[f < filter_] for f in filters]
        names, codes = np.unique(np.concatenate(earlier), return_inverse=True)
        if len(names):
            sets = np.zeros((len(rep), len(names)), np.float32)
            sets[np.repeat(np.arange(len(rep)), [len(e) for e in earlier]), codes] = 1
            close &= sets[first] @ sets[second].T < 0.5
        count = np.zeros(len(rep), np.int64)
        count[first] += close @ n[second]
        if i != j:
            count[second] += close.T @ n[first]
        forest = Forest(len(rep))
        for a in np.flatnonzero(close.any(axis=1)):
            for b in np.flatnonzero(close[a]):
                forest.join(int(first[a]), int(second[b]))
        for k in np.flatnonzero(count):
            yield int(rep[k]), int(count[k]), int(rep[forest.root(int(k))])

    def run(batches):
        now, held = None, []

        def flush():
            if not held:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["rep", "links", "root"])
            t = pa.Table.from_batches(held).combine_chunks()
            rows = []
            if t.num_rows > 1:
                column = lambda c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
                lists = column(9)
                flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
                rows = list(links(now[1], now[2], now[3], now[4], column(5).to_numpy(), column(6).to_numpy(), column(7).to_numpy(), column(8), [flat[a:b] for a, b in zip(at, at[1:])]))
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["rep", "links", "root"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(5)])
            edge = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge, edge[1:]):
                if a == b:
                    continue
                key = tuple(int(k) for k in keys[:, a])
                if key != now:
                    if held:
                        yield flush()
                    now, held = key, []
                held.append(batch.slice(a, b - a))
        yield flush()

    return rows.sortWithinPartitions("label", "dim", "filter", "i", "j", "rep").mapInArrow(run, "rep long, links long, root long")


def dedup(spark: SparkSession, embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings`` (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine reaches the least one. Null
    labels and ids, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing; neither do vectors of different length. Rows with equal
    vectors link with each other; rows that share an id but not the vector are judged each on
    its own. Other columns are ignored.
    """
    scratch = Scratch(spark, "embeddings")
    rows = scratch.keep(vectors(embeddings), "rows")
    classes = rows.where("vec IS NOT NULL").groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    # A class goes by a number of its own: an id may stand in rows of several classes.
    classes = scratch.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = scratch.keep(compared(scratch.keep(filtered(classes, settings), "cells"), settings), "found")
    roots = components(spark, found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    placed = classes.select("label", "key", "rep", "least", "n").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    by_class = placed.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "label", "key").join(by_class, ["label", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
