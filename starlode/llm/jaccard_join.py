"""N-gram Jaccard join over a prefix tree.

Documents with equal sets of shingles are one class; classes are joined exactly:

1. All shingles get a global order: first those of a pool (a quarter, by hash), the rare
   ones before the frequent ones, then the rest by hash. Any order gives the same links;
   this one needs exact counts of the pool alone. Linked sets share a shingle among the
   first ``n - ceil(t * n) + 1`` of this order, so classes of fitting sizes that share such
   a shingle meet in the group of its smallest class. Shingles of a single class lead
   nowhere and are dropped when counted.
2. In a group, sets lie in a prefix tree (most frequent shingle of the group first). A
   set walks the tree once for all others: paths share the overlap counted so far, and a
   subtree ends as soon as its missing or remaining shingles exclude the needed overlap.
   Pairs that are connected already are not compared.
3. Groups of over ``block`` sets are split by a hash of set and group, so sets that share many
   shingles meet others in each of their groups. After the blocks' own joins, the group's
   sets outside its largest component walk the trees of all blocks, so no pair of
   different components stays uncompared.

Nothing is capped: a group of any size is dealt out in blocks of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as V
from .bloom import Table, table_of
from .common import Forest, Scratch, components


@dataclass(frozen=True)
class Settings:
    """k: words of a shingle. num / den: the least Jaccard similarity. block: sets in a tree."""

    k: int = 3
    num: int = 90
    den: int = 100
    block: int = 1024


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, _, _, first = V.word_hashes(*V.text_bytes(column))
    sh, edge = V.shingle_hashes(hashes, first, k)
    return [np.unique(sh[edge[d] : edge[d + 1]]) for d in range(len(column))]


#: Hashes below this are the pool of the global order.
POOL = 1 << 62


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row tells rows apart and is the same at every scan of a table."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def documents_of(docs: DataFrame, s: Settings) -> DataFrame:
    """(row, doc_id, n, sig, pool) of every document: sig is a 128-bit digest of its set, pool its shingles of the pool and,
    if they are fewer than a prefix, as many of the others as a prefix then holds."""
    import xxhash

    def first(shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        return shingles[: max(int(np.searchsorted(shingles, np.uint64(POOL))), n + (-s.num * n // s.den) + 1 if n else 0)]

    def run(batches):
        for batch in batches:
            for part in V.slices(batch):
                sets = shingle_sets(part.column(2), s.k)
                sig = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                heads = [first(x) for x in sets]
                edge = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
                flat = np.concatenate([*heads, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([len(x) for x in sets], pa.int64()), pa.array(sig, pa.binary()), lists], ["row", "doc_id", "n", "sig", "pool"])

    return numbered(docs).mapInArrow(run, "row long, doc_id long, n long, sig binary, pool array<long>")


def prefixes(classes: DataFrame, s: Settings) -> DataFrame:
    """(rep, n, token): those shingles of each class's prefix that other classes hold too; classes is (rep, n, pool)."""
    from pyspark.sql import Window as W

    tokens = classes.select("rep", "n", F.explode("pool").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    pooled = F.col("token").between(0, POOL - 1)
    own = W.partitionBy("rep")
    size = classes.select("rep", F.size(F.filter("pool", lambda x: x.between(0, POOL - 1))).alias("size"))
    kept = tokens.join(shared, "token").withColumn("pooled", pooled)
    ranked = kept.withColumn("at", F.row_number().over(own.orderBy(F.desc("pooled"), "df", "token"))).withColumn("common", F.count_if("pooled").over(own))
    # The pool's shingles that no other class has come first: size - common of them.
    room = F.expr(f"n - ({s.num} * n + {s.den - 1}) div {s.den} + 1") - (F.col("size") - F.col("common"))
    return ranked.join(size, "rep").where(~F.col("pooled") | (F.col("at") <= room)).select("rep", "n", "token")


def sets_of(docs: DataFrame, wanted: Table, s: Settings) -> DataFrame:
    """(rep, shingles) of the rows in the table ``wanted``, and of few others."""
    shared = wanted.shared(docs.sparkSession)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(shared.value.holds(batch.column(0).to_numpy())))
            for part in V.slices(batch):
                sets = shingle_sets(part.column(1), s.k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "shingles"])

    return numbered(docs).select("row", "text").mapInArrow(run, "rep long, shingles binary")


# ---------------------------------------------------------------- the tree


class Node:
    """A path of shingles, the sets that end at it, and the smallest and largest size of the sets at or below it."""

    __slots__ = ("path", "kids", "ends", "low", "high")

    def __init__(self, path: np.ndarray, size: int):
        self.path, self.kids, self.ends, self.low, self.high = path, {}, [], size, size


class Tree:
    """A prefix tree of ordered shingle sets with compressed paths."""

    def __init__(self, s: Settings):
        self.top, self.s = Node(np.zeros(0, np.int32), 0), s
        self.top.low = 1 << 60

    def add(self, items: np.ndarray, who: int) -> None:
        node, at, n = self.top, 0, len(items)
        node.low, node.high = min(node.low, n), max(node.high, n)
        while at < n:
            kid = node.kids.get(int(items[at]))
            if kid is None:
                kid = node.kids[int(items[at])] = Node(items[at:], n)
                node, at = kid, n
                break
            m = min(len(kid.path), n - at)
            differ = np.flatnonzero(kid.path[:m] != items[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(kid.path):
                fork = Node(kid.path[:same], n)
                fork.low, fork.high = kid.low, kid.high
                kid.path = kid.path[same:]
                fork.kids[int(kid.path[0])] = kid
                node.kids[int(fork.path[0])] = fork
                kid = fork
            kid.low, kid.high = min(kid.low, n), max(kid.high, n)
            node, at = kid, at + same
        node.ends.append(who)

    def linked(self, items: np.ndarray, mask: np.ndarray, skip):
        """Yields the sets that link with ``items`` (mask: its shingles); those for which skip(who) holds are passed over."""
        n, num, den = len(items), self.s.num, self.s.den
        # den * I >= num * U with U = n + m - I: I >= num * (n + m) / (num + den)
        stack = [(kid, 0, 0) for kid in self.top.kids.values()]
        while stack:
            node, depth, overlap = stack.pop()
            if den * node.high < num * n or den * n < num * node.low:
                continue
            depth += len(node.path)
            overlap += int(np.count_nonzero(mask[node.path]))
            # A set of m shingles below shares at most min(m - depth, n - overlap) more; this is the m that comes nearest to what it needs.
            m = min(max(depth + n - overlap, node.low, depth), node.high)
            if (num + den) * (overlap + min(m - depth, n - overlap)) < num * (n + m):
                continue
            for who in node.ends:
                if not skip(who) and (num + den) * overlap >= num * (n + depth):
                    yield who
            stack.extend((kid, depth, overlap) for kid in node.kids.values())


def dense(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets as ordered numbers, the group's most frequent shingle first."""
    flat = np.concatenate(sets)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int32)
    rank[np.lexsort((np.arange(len(counts)), -counts))] = np.arange(len(counts), dtype=np.int32)
    edge = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    return [np.sort(rank[inverse[edge[i] : edge[i + 1]]]) for i in range(len(sets))], len(counts)


def tree_links(sets: list[np.ndarray], labels: list[int], queries: list[bool], inserts: list[bool], s: Settings) -> list[tuple[int, int]]:
    """Links that connect everything connected among sets: at most one for each merge. Sets with equal labels count as connected."""
    items, width = dense(sets)
    forest, seen, out = Forest(len(sets)), {}, []
    for i, label in enumerate(labels):
        forest.join(seen.setdefault(label, i), i)
    tree, mask = Tree(s), np.zeros(width, bool)
    first = [i for i in range(len(sets)) if inserts[i] and not queries[i]]
    rest = sorted((i for i in range(len(sets)) if queries[i]), key=lambda i: len(sets[i]))
    for i in first:
        tree.add(items[i], i)
    roots = {forest.root(i) for i in first}
    for i in rest:
        if roots - {forest.root(i)}:
            mask[items[i]] = True
            for j in tree.linked(items[i], mask, lambda j: forest.root(j) == forest.root(i)):
                forest.join(i, j)
                out.append((i, j))
                roots = {forest.root(x) for x in roots}
                if not roots - {forest.root(i)}:
                    break
            mask[items[i]] = False
        if inserts[i]:
            tree.add(items[i], i)
            roots = {forest.root(x) for x in roots} | {forest.root(i)}
    return out


def group_links(grouped: DataFrame, s: Settings) -> DataFrame:
    """Rows (g, block, part, doc_id, label, query, base, shingles) to edges (a, b); a group (g, block, part) is bounded by the settings."""

    def run(batches):
        held: dict = {}
        now = None

        def flush():
            if held and len(held["id"]) > 1:
                for i, j in tree_links(held["set"], held["label"], held["query"], held["base"], s):
                    yield held["id"][i], held["id"][j]

        def out(pairs):
            pairs = list(pairs)
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            rest = [batch.column(c).to_pylist() for c in range(3, 8)]
            for k, doc, label, query, base, data in zip(key, *rest):
                if k != now:
                    yield from out(flush())
                    now, held = k, {"id": [], "label": [], "query": [], "base": [], "set": []}
                for name, x in (("id", doc), ("label", label), ("query", query), ("base", base), ("set", np.frombuffer(data, np.uint64))):
                    held[name].append(x)
        yield from out(flush())

    columns = ["g", "block", "part", "doc_id", "label", "query", "base", "shingles"]
    return grouped.select(*columns).repartition("g", "block", "part").sortWithinPartitions("g", "block", "part", "doc_id").mapInArrow(run, "a long, b long")


def join(spark: SparkSession, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    A text is its words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; its set holds its
    distinct shingles (64-bit hashes of them), with fewer words than a shingle the whole
    sequence. Empty and null texts have n_shingles 0 and are their own component. Rows with
    one id give a row each, judged by their own sets, also where their texts differ. A null
    id stays null and takes no part in the components. Other columns are ignored. ``docs``
    has to give the same rows at every scan.
    """
    return components_of(spark, docs, settings).select("doc_id", "n_shingles", "component_id")


def components_of(spark: SparkSession, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, stays): as ``join``; row is ``numbered``'s, stays whether a row is its component's
    first by id and row. Rows without words or id stay."""
    s, scratch = settings, Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    full = scratch.keep(documents_of(docs, s), "full", "lz4")
    rows = scratch.keep(full.drop("pool"), "rows")
    # A class has equal sets; it goes by the row of its smallest id. Copies in a task are one row before the shuffle.
    key = F.struct("doc_id", "row")
    known = full.where("doc_id IS NOT NULL AND sig IS NOT NULL").groupBy("sig").agg(F.min(key).alias("head"), F.min_by(F.struct("n", "pool"), key).alias("own"))
    classes = scratch.keep(known.select("sig", "head", F.col("head.row").alias("rep"), "own.n", "own.pool"), "classes", "lz4")
    first = scratch.keep(classes.select("sig", "rep", "head"), "first")
    scratch.drop("full")
    classes = classes.select("rep", "n", "pool")
    level = F.floor(F.log("n") / math.log(s.den / s.num) * (1 - 1e-9))  # sizes of linked sets are a level apart at most
    heads = prefixes(classes, s).select("rep", "token", F.explode(F.array(level, level + 1)).alias("level"))
    heads = scratch.keep(heads, "heads")
    scratch.drop("classes")
    tokens = heads.groupBy("token", "level").agg(F.min("rep").alias("g"), F.max("rep").alias("last")).where("g < last").select("token", "level", "g")
    met = scratch.keep(heads.join(tokens, ["token", "level"]).select("g", "rep").distinct(), "met")
    wanted = table_of(met.select("rep").distinct())
    sets = scratch.keep(sets_of(docs, wanted, s), "sets", "lz4")
    sizes = met.groupBy("g").agg(F.count("*").alias("size"))
    dealt = met.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("rep", "g"), F.ceil(F.col("size") / s.block)).cast("int"))
    own = dealt.join(sets, "rep").select("g", "block", F.lit(0).alias("part"), F.col("rep").alias("doc_id"), F.col("rep").alias("label"), F.lit(True).alias("query"), F.lit(True).alias("base"), "shingles")
    edges = scratch.keep(group_links(own, s), "edges")
    roots = components(spark, edges, scratch, "within")

    # Between the blocks of a large group: its sets outside the largest component against all of them.
    split = dealt.where(F.col("size") > s.block).join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("g", "rep", "block", "size", F.coalesce("root", "rep").alias("label"))
    split = scratch.keep(split, "split")
    if split.limit(1).count():
        major = split.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("major"))
        odd = split.join(major, "g").where("label <> major")
        parts = odd.groupBy("g").agg(F.ceil(F.count("*") / s.block).cast("int").alias("parts"))
        odd = odd.join(parts, "g").select("g", "rep", "label", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.ceil(F.col("size") / s.block).cast("int").alias("blocks"))
        asked = odd.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", F.col("rep").alias("doc_id"), "label", F.lit(True).alias("query"), F.lit(False).alias("base"))
        held = split.join(parts, "g").select("g", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rep").alias("doc_id"), "label", F.lit(False).alias("query"), F.lit(True).alias("base"))
        both = asked.union(held).join(sets.withColumnRenamed("rep", "doc_id"), "doc_id")
        across = scratch.keep(group_links(both, s), "across")
        roots = components(spark, edges.union(across), scratch, "all")

    # The smallest id of a component: a class without links is its own.
    placed = first.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = placed.groupBy("root").agg(F.min("head").alias("least"))
    by_class = placed.join(least, "root").select("sig", "least")
    # Rows of a class may be a third of all: the join is by class, and AQE splits it.
    out = rows.join(by_class, "sig", "left")
    own = F.col("sig").isNotNull() & F.col("doc_id").isNotNull()
    return out.select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce(~own | (F.col("row") == F.col("least.row")), F.lit(True)).alias("stays"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
