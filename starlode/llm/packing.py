"""Sum-of-squares packing of token pieces into sequences of a fixed length.

Documents longer than a sequence are cut, from their end, into whole sequences; the rest
is their first piece. Pieces are dealt by hash into shares of ``share`` pieces on average
and each share is packed on its own, the longest pieces first: a piece goes where the
squared counts of the open sequences per residual gap become smallest. A share's
sequences that stay open below ``full`` are taken apart and their pieces packed once more,
in as many shares as they fill, until a single share is left or their number doesn't fall:
then they are pieces that leave sequences open however they are dealt. No share is larger
than the first ones.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import encoder


@dataclass(frozen=True)
class Settings:
    """length: tokens of a sequence. end: the id behind each document. share: pieces that a task packs on average. full: part of a sequence that closes it. fan_in: by how much a level has fewer shares than the one before, at most."""

    length: int = 2048
    end: int = 0
    share: int = 1 << 15
    full: float = 0.98
    fan_in: int = 8


def pieces_of(docs: DataFrame, vocabulary: str, s: Settings, with_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]) of each document's pieces; row tells documents with one id apart."""

    def run(batches):
        from . import textvec as V

        tool = encoder(vocabulary, "byte")
        for batch in batches:
            for part in V.slices(batch, limit=4 << 20):
                ids, first = tool.encode(part.column(2))
                out: list[list] = [[], [], [], []]
                rows, blobs = [], []
                for d in range(part.num_rows):
                    own = np.append(ids[first[d] : first[d + 1]], s.end).astype("<u4")
                    head = len(own) % s.length or s.length
                    at, piece = 0, 0
                    while at < len(own):
                        size = head if not at else s.length
                        blob = own[at : at + size].tobytes()
                        rows.append(d)
                        for column, value in zip(out, (piece, at, size, zlib.crc32(blob))):
                            column.append(value)
                        if with_ids:
                            blobs.append(blob)
                        at, piece = at + size, piece + 1
                take = pa.array(rows, pa.int64())
                columns = [part.column(0).take(take), part.column(1).take(take), *(pa.array(x, pa.int64()) for x in out)]
                names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(blobs, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, row long, piece long, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return numbered.mapInArrow(run, schema)


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sizes in the order given: each one's sequence (numbered from 0) and offset.

    The count of open sequences with gap g is n[g]. Putting a size into a gap g changes the
    sum of squares by 2 * (n[g - size] - n[g] + 1), or -2 * n[g] + 1 if it fills it; a new
    sequence by 2 * n[length - size] + 1. The least change wins, the smallest gap of equals.
    """
    n = np.zeros(length + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for k, size in enumerate(sizes.tolist()):
        if size == length:
            bins[k], offsets[k], made = made, 0, made + 1
            continue
        there = n[size:length]
        change = 2 * (n[: length - size] - there + 1)
        change[0] = 1 - 2 * there[0]
        change[there == 0] = never
        best = int(np.argmin(change)) if len(change) else 0
        if len(change) and change[best] <= 2 * n[length - size] + 1:
            gap = size + best
            n[gap] -= 1
            b = open_[gap].pop()
        else:
            gap, b, made = length, made, made + 1
        bins[k], offsets[k] = b, length - gap
        if gap > size:
            n[gap - size] += 1
            open_[gap - size].append(b)
    return bins, offsets


def place(pieces: DataFrame, share: str, s: Settings) -> DataFrame:
    """Packs each ``share``: adds (bin, offset) to (doc_id, row, piece, length). A share is of bounded size, its task holds only numbers."""

    def run(batches):
        held: list[pa.RecordBatch] = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        key, size = table["share"].to_numpy(), table["length"].to_numpy()
        order = np.lexsort((table["piece"].to_numpy(), table["row"].to_numpy(), -size, key))
        key, size = key[order], size[order]
        edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1)).tolist() + [len(key)]
        for i, j in zip(edge, edge[1:]):
            bins, offsets = sum_of_squares(size[i:j], s.length)
            part = table.take(pa.array(order[i:j]))
            used = np.bincount(bins, size[i:j])[bins].astype(np.int64)
            arrays = [*(part[c].combine_chunks() for c in ("row", "piece", "length", "share")), pa.array(bins), pa.array(offsets), pa.array(used)]
            yield pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], ["row", "piece", "length", "share", "bin", "offset", "used"])

    schema = "row long, piece long, length long, share long, bin long, offset long, used long"
    return pieces.select("row", "piece", "length", F.col(share).cast("long").alias("share")).repartition("share").mapInArrow(run, schema)


def assign(pieces: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """(row, piece, sequence_id, offset) of (row, piece, length): no sequence is longer than the length, none has a gap inside."""
    rest, done, level = pieces.select("row", "piece", "length"), None, 0
    shares = max(1, -(-pieces.count() // s.share))
    while True:
        level += 1
        dealt = rest.withColumn("share", F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(shares)))
        packed = scratch.keep(place(dealt, "share", s), f"level{level}")
        rest = packed.where(F.col("used") < s.full * s.length).select("row", "piece", "length")
        fewer = max(1, -(-rest.count() // s.share), shares // s.fan_in)
        last = fewer >= shares
        closed = packed if last else packed.where(F.col("used") >= s.full * s.length)
        # (level, share, bin) in one number: 8, 27 and 28 bits.
        named = closed.select("row", "piece", (F.lit(level) * (1 << 55) + F.col("share") * (1 << 28) + F.col("bin")).alias("sequence_id"), "offset")
        done = named if done is None else done.union(named)
        if last:
            return done
        shares = fewer


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of ``docs`` (doc_id, text).

    Null and empty texts are pieces of the end id alone. Rows with one id, or none, are
    packed each on its own. Other columns are ignored. Sequences with their ids come from
    ``sequences``.
    """
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces_of(docs, vocabulary, settings), "pieces")
    return cut.join(assign(cut, scratch, settings), ["row", "piece"]).drop("row")


def sequences(spark: SparkSession, docs: DataFrame, vocabulary: str, settings: Settings = Settings()) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, little-endian 32-bit ids; each is bounded by the length."""
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces_of(docs, vocabulary, settings, with_ids=True), "pieces")
    placed = cut.select("row", "piece", "ids").join(assign(cut.select("row", "piece", "length"), scratch, settings), ["row", "piece"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return placed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
