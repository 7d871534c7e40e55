"""Document fingerprints by improbable features.

Every window of ``width`` bytes has a Shannon entropy. Windows rank by how rare their
entropy is in the whole corpus; a window that ranks first in at least ``popularity`` of the
``span`` windows around it is a feature. Features go into Bloom filters of 2,048 bits, a
new one following after ``per_filter`` features, and the chain of filters is the
fingerprint. Two fingerprints are as alike as the normalised overlap of their filters' bits.
"""

from __future__ import annotations

import base64
import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as V
from .common import labels

BITS, HASHES = 2048, 5


@dataclass(frozen=True)
class Settings:
    """levels: steps of entropy that are ranked."""

    width: int = 10
    span: int = 8
    popularity: int = 2
    per_filter: int = 160
    levels: int = 1000


@lru_cache(maxsize=4)
def _terms(width: int) -> np.ndarray:
    """c * log2(c) for counts up to width + 1, in whole 2^-24ths, so that sums don't depend on what stands before."""
    c = np.arange(width + 2, dtype=np.float64)
    return np.round(np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0.0) * (1 << 24)).astype(np.int64)


def entropy_levels(data: np.ndarray, s: Settings) -> np.ndarray:
    """The entropy level of each window of ``data`` (len - width + 1 of them)."""
    w, n = s.width, len(data)
    if n < w:
        return np.zeros(0, np.int32)
    # Equal bytes within the window's reach, after and before each place: what changes as it slides.
    after, before = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for lag in range(1, w):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        after[: n - lag] += same
        before[lag:] += same
    terms = _terms(w)
    steps = terms[1:] - terms[:-1]
    total = np.empty(n - w + 1, np.int64)
    total[0] = terms[np.bincount(data[:w], minlength=256)].sum()
    # Out goes data[i] (counted among i .. i+w-1), in comes data[i+w] (counted among i+1 .. i+w).
    np.cumsum(steps[before[w:] - 1] - steps[after[: n - w] - 1], out=total[1:])
    total[1:] += total[0]
    most = int(np.log2(w) * (1 << 24)) * w
    return ((most - total) * s.levels // most).clip(0, s.levels).astype(np.int32)


def levels_of_all(texts: list[np.ndarray], s: Settings) -> list[np.ndarray]:
    """entropy_levels of several texts by one pass over all their bytes."""
    every = entropy_levels(np.concatenate([*texts, np.zeros(0, np.uint8)]), s)
    edge = np.cumsum([0, *map(len, texts)])
    return [every[e : e + max(len(t) - s.width + 1, 0)] for e, t in zip(edge.tolist(), texts)]


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each level: 0 for the rarest, ties by level; windows of one repeated byte (level 0) rank last."""
    order = np.lexsort((np.arange(len(counts)), counts))
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    rank[0] = len(counts)
    return rank


def feature_places(levels: np.ndarray, rank: np.ndarray, s: Settings) -> np.ndarray:
    """Windows that have the best rank (the leftmost of equals) in at least ``popularity`` runs of ``span`` windows.

    A document with fewer windows than a run has one run, and its best window is a feature;
    so is the most popular window of a document in which none is popular enough.
    """
    n = len(levels)
    if not n:
        return np.zeros(0, np.int64)
    key = (rank[levels] << 40) + np.arange(n)
    if n <= s.span:
        return np.array([int(key.min()) & ((1 << 40) - 1)])
    # Minima of all runs from minima that grow forwards and backwards within blocks of span.
    blocks = -(-n // s.span)
    padded = np.full(blocks * s.span, np.iinfo(np.int64).max)
    padded[:n] = key
    grid = padded.reshape(blocks, s.span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[: n - s.span + 1], ahead[s.span - 1 : n]) & ((1 << 40) - 1)
    wins = np.bincount(best, minlength=n)
    found = np.flatnonzero(wins >= s.popularity)
    return found if len(found) else np.array([int(np.argmax(wins))])


def filters(data: np.ndarray, levels: np.ndarray, rank: np.ndarray, s: Settings) -> np.ndarray:
    """The chain of Bloom filters (rows of BITS / 8 bytes) of a text. A text shorter than a window is its one feature."""
    n = len(data)
    if not n:
        return np.zeros((0, BITS // 8), np.uint8)
    w, at = (n, np.zeros(1, np.int64)) if n < s.width else (s.width, feature_places(levels, rank, s))
    powers = np.array([pow(V.BASE, j + 1, 1 << 64) for j in range(w)], np.uint64)
    hashes = V.mix(((data[at[:, None] + np.arange(w)].astype(np.uint64) + np.uint64(1)) * powers).sum(axis=1))
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]  # a repeated feature counts once
    chain = np.arange(len(hashes)) // s.per_filter
    out = np.zeros((int(chain[-1]) + 1, BITS), bool)
    for j in range(HASHES):
        out[chain, ((hashes >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1)


def text_of(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best filter of the other, weighted by bits, as overlap beyond chance over the most there can be.

    Two empty fingerprints are alike (1), an empty one and another not (0).
    """
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if len(x) > len(y) or (len(x) == len(y) and x.tobytes() > y.tobytes()):
        x, y = y, x
    a, b = np.unpackbits(x, axis=1).astype(np.float32), np.unpackbits(y, axis=1).astype(np.float32)
    na, nb = a.sum(1), b.sum(1)
    common = a @ b.T
    chance = np.outer(na, nb) / BITS
    most = np.minimum.outer(na, nb)
    score = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float((score.max(1) * na).sum() / na.sum())


def level_counts(docs: DataFrame, s: Settings) -> np.ndarray:
    """How many windows of all texts have each level: levels + 1 numbers, whatever the corpus."""

    def run(batches):
        counts = np.zeros(s.levels + 1, np.int64)
        for batch in batches:
            for part in V.slices(batch):
                data, offsets = V.text_bytes(part.column(0))
                levels = entropy_levels(data, s)
                edge = offsets[1:-1]  # windows over a document's end don't count
                across = np.zeros(len(levels) + s.width, bool)
                for e in edge.tolist():
                    across[max(e - s.width + 1, 0) : e] = True
                counts += np.bincount(levels[~across[: len(levels)]], minlength=s.levels + 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["level", "n"])

    out = np.zeros(s.levels + 1, np.int64)
    for row in docs.select("text").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[row["level"]] = row["n"]
    return out


def fingerprints(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``fingerprint`` (base64 of the filters) of its ``text``; null and empty texts have an empty one."""
    from pyspark.sql import types as T

    s, rank = settings, rarity(level_counts(docs, settings))
    docs = docs.drop("fingerprint")

    def run(batches):
        for batch in batches:
            for part in V.slices(batch):
                data, offsets = V.text_bytes(part.column(part.schema.get_field_index("text")))
                texts = [data[i:j] for i, j in zip(offsets, offsets[1:])]
                marks = [text_of(filters(t, x, rank, s)) for t, x in zip(texts, levels_of_all(texts, s))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks, pa.string())], [*part.schema.names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, ghost, doc_id, text): documents dealt into consecutive ranges of doc_id, each followed by a copy of the
    next range's first (ghost), after the last range the first of all. Only the ranges' bounds reach the driver.
    Within a range, rows are in the order of doc_id, then text; null ids come first.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = docs.select(key.alias("key"), "doc_id", "text")
    cut = docs.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10000)).first()[0] or []
    cuts = sorted(set(cut))
    # A key's range is the number of bounds not above it: first among every k-th, then among the k behind.
    if cuts:
        k = math.isqrt(len(cuts)) + 1
        below = lambda values: F.size(F.filter(values, lambda c: c <= F.col("key")))
        docs = docs.withColumn("block", below(F.array(*map(F.lit, cuts[::k]))))
        inside = F.slice(F.array(*map(F.lit, cuts)), F.greatest(F.col("block") - 1, F.lit(0)) * k + 1, F.lit(k))
        bucket = F.when(F.col("block") > 0, (F.col("block") - 1) * k + below(inside)).otherwise(0)
    else:
        bucket = F.lit(0)
    ranged = docs.withColumn("bucket", bucket.cast("int")).drop("block")
    full = [r["bucket"] for r in ranged.groupBy("bucket").agg(F.count("*")).select("bucket").collect()]
    full.sort()
    if not full:
        return ranged.select("bucket", F.lit(False).alias("ghost"), "doc_id", "text")
    # Each range's first row, by (key, text): n rows at most.
    heads = ranged.groupBy("bucket").agg(F.min(F.struct("key", F.coalesce(F.sha2("text", 256), F.lit("")).alias("h"))).alias("x")).select("bucket", "x.key", "x.h").collect()
    before = {b: full[i - 1] for i, b in enumerate(full)}
    rows = [(r["bucket"], r["key"], r["h"], before[r["bucket"]]) for r in heads]
    bounds = F.broadcast(spark.createDataFrame(rows, "b int, k long, h string, to int"))
    sure = F.coalesce(F.sha2("text", 256), F.lit(""))
    ghosts = ranged.join(bounds, (F.col("bucket") == F.col("b")) & (F.col("key") == F.col("k")) & (sure == F.col("h")))
    ghosts = ghosts.dropDuplicates(["b"]).select(F.col("to").alias("bucket"), F.lit(True).alias("ghost"), "doc_id", "text")
    return ranged.select("bucket", F.lit(False).alias("ghost"), "doc_id", "text").union(ghosts)


def compare_edited(spark: SparkSession, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fingerprints each row of ``docs`` (doc_id, text) and its edited text, and compares both, and it with the next row.

    The edited text has the last floor(n / 4) of its n code points replaced by the first
    as many (or all) of the next document's, in ascending doc_id; after the last comes the
    first. Rows with one id follow each other by the digest of their texts. Null texts are empty. A
    lone document is its own next. Other columns are ignored; a null text counts as empty in order, too.
    """
    s, rank = settings, rarity(level_counts(docs, settings))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def results(pairs):
        """Rows of (document, next document), each as (doc_id, text, bytes, levels, filters). What an edited text keeps keeps its levels."""
        kept, edits = [], []
        for (_, text, data, _, _), (_, after, *_) in pairs:
            n = len(text)
            head = len(text[: n - n // 4].encode())
            edits.append(np.concatenate([data[:head], np.frombuffer(after[: n // 4].encode(), np.uint8)]))
            kept.append(max(head - s.width + 1, 0))
        tails = levels_of_all([e[k:] for e, k in zip(edits, kept)], s)
        rows = []
        for ((doc, text, data, levels, own), following), edited, k, tail in zip(pairs, edits, kept, tails):
            new = filters(edited, np.concatenate([levels[:k], tail]), rank, s)
            rows.append((doc, len(text), hashlib.sha256(edited.tobytes()).hexdigest(), text_of(own), text_of(new), likeness(own, new), likeness(own, following[4])))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def run(batches):
        held, now = None, None
        for batch in batches:
            for part in V.slices(batch, "text"):
                data, offsets = V.text_bytes(part.column(3))
                texts = [data[i:j] for i, j in zip(offsets, offsets[1:])]
                pairs = []
                for bucket, ghost, doc, text, raw, levels in zip(*(part.column(i).to_pylist() for i in range(4)), texts, levels_of_all(texts, s)):
                    this = (doc, text or "", raw, levels, filters(raw, levels, rank, s))
                    if held is not None and bucket == now:
                        pairs.append((held, this))
                    held, now = (None if ghost else this), bucket
                if pairs:
                    yield results(pairs)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A range to each partition.
    dealt = in_order(docs).withColumn("label", F.array(*map(F.lit, labels(spark)))[F.col("bucket")]).repartition("label").drop("label").sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_first(), F.coalesce(F.sha2("text", 256), F.lit("")))
    return dealt.mapInArrow(run, schema)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
