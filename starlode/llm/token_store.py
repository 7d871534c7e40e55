"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's id stream into chunks, so equal stretches
become equal chunks wherever they stand. The store's folders (Parquet, written and read by
Spark alone):

* ``chunks/``: (hash, data), each distinct chunk once; data is a byte with the width of an
  id (2 or 4), then the ids, little-endian; hash its 128-bit BLAKE2b.
* ``recipes/``: (doc_id, row, part, start, n_tokens, chunks, root) in ascending doc_id,
  part by part; start counts within the part, root is the Merkle root of the chunk hashes.
* ``manifest/``: (part, base, n_documents, n_tokens, root), root over the part's roots.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as V
from .common import Scratch, delete
from .tokens import encoder


@dataclass(frozen=True)
class Settings:
    """end: the id behind each document. window: ids that a cut depends on. mean, least, most: ids of a chunk."""

    end: int = 1
    window: int = 8
    mean: int = 512
    least: int = 64
    most: int = 4096


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; a lone node of a level moves up as it is, no leaves hash as empty data."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def candidates(ids: np.ndarray, edge: np.ndarray, s: Settings) -> np.ndarray:
    """Places behind ids whose rolling hash is among the smallest of ``mean``; a hash's window lies in one document (``edge``: len + 1 bounds)."""
    n = len(ids) - s.window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mixed = V.mix(np.arange(int(ids.max()) + 1, dtype=np.uint64) + np.uint64(1))[ids]
    rolled = mixed[:n].copy()
    for j in range(1, s.window):
        rolled *= np.uint64(V.BASE)
        rolled += mixed[j : j + n]
    found = np.flatnonzero(V.mix(rolled) < np.uint64((1 << 64) // s.mean)) + s.window
    return found[found - edge[np.searchsorted(edge, found - 1, side="right") - 1] >= s.window]


def cuts(found: list[int], n: int, s: Settings) -> list[int]:
    """Where a document of n ids is cut, its end included: at the places found, within the size limits."""
    ends: list[int] = []
    at = 0
    if n > s.least:
        for cut in [*found, n]:
            while cut - at > s.most:
                at += s.most
                ends.append(at)
            if cut - at >= s.least and n - cut >= s.least:
                ends.append(cut)
                at = cut
    return [*ends, n]


def pack_ids(ids: np.ndarray) -> bytes:
    wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([wide]) + ids.astype(f"<u{wide}").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


LOADED = "doc_id long, row long, n_tokens long, chunks array<binary>, sizes array<int>, root binary, data array<binary>"


def recipes_of(docs: DataFrame, vocabulary: str, s: Settings) -> DataFrame:
    """(doc_id, row, n_tokens, chunks, sizes, root, data): every document's recipe; a task hands on data only with a chunk's first occurrence."""
    names = [f.split()[0] for f in LOADED.split(", ")]

    def run(batches):
        tool, seen = encoder(vocabulary, "word"), set()
        for batch in batches:
            for part in V.slices(batch, limit=4 << 20):
                plain, first = tool.encode(part.column(2))
                rows = part.num_rows
                edge = first + np.arange(rows + 1)
                ids, inside = np.full(len(plain) + rows, s.end, np.uint32), np.ones(len(plain) + rows, bool)
                inside[edge[1:] - 1] = False
                ids[inside] = plain
                places = candidates(ids, edge, s)
                bounds = np.searchsorted(places, edge, side="right").tolist()
                places, start = places.tolist(), edge.tolist()
                wide = np.maximum.reduceat(ids, edge[:-1]) >= 1 << 16 if rows else []
                raw = {2: ids.astype("<u2").tobytes(), 4: ids.astype("<u4").tobytes() if any(wide) else b""}
                hashes, sizes, data, count, roots = [], [], [], [0], []
                for d in range(rows):
                    a, size = start[d], 4 if wide[d] else 2
                    at, own, mark = a, len(hashes), bytes([size])
                    for cut in cuts([p - a for p in places[bounds[d] : bounds[d + 1]]], start[d + 1] - a, s):
                        blob = mark + raw[size][at * size : (a + cut) * size]
                        h = digest(blob)
                        hashes.append(h)
                        sizes.append(a + cut - at)
                        data.append(None if h in seen else blob)
                        seen.add(h)
                        at = a + cut
                    count.append(len(hashes))
                    roots.append(merkle(hashes[own:]))
                lists = [pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(x, k)) for x, k in ((hashes, pa.binary()), (sizes, pa.int32()), (data, pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(edge)), *lists[:2], pa.array(roots, pa.binary()), lists[2]], names)

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return numbered.mapInArrow(run, LOADED)


def write(spark: SparkSession, docs: DataFrame, path: str, vocabulary: str, settings: Settings = Settings()) -> None:
    """Encodes ``docs`` (doc_id, text) by a word vocabulary and writes the store at ``path``.

    Null and empty texts are the end id alone. Rows with one id follow each other; rows
    without an id come first. Other columns are ignored.
    """
    recipes_of(docs, vocabulary, settings).write.option("compression", "zstd").parquet(f"{path}/load")
    load = spark.read.schema(LOADED).parquet(f"{path}/load")
    # A chunk's data come once from each task that has it, however many documents share it.
    fresh = load.select(F.explode(F.arrays_zip("chunks", "data")).alias("c")).where("c.data IS NOT NULL").select(F.col("c.chunks").alias("hash"), "c.data")
    fresh.groupBy("hash").agg(F.first("data").alias("data")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    def number(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([part] * batch.num_rows, pa.int32()), pa.array(start), *batch.columns[2:]], ["doc_id", "row", "part", "start", "n_tokens", "chunks", "sizes", "root"])

    schema = "doc_id long, row long, part int, start long, n_tokens long, chunks array<binary>, sizes array<int>, root binary"
    load.drop("data").repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").mapInArrow(number, schema).write.option("compression", "zstd").parquet(f"{path}/recipes")
    delete(spark, f"{path}/load")

    manifest = manifest_rows(spark, path).collect()  # a row for each part
    base, rows = 0, []
    for row in sorted(manifest, key=lambda r: r["part"]):
        rows.append((row["part"], base, row["n_documents"], row["n_tokens"], row["root"]))
        base += row["n_tokens"]
    spark.createDataFrame(rows, "part int, base long, n_documents long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def manifest_rows(spark: SparkSession, path: str) -> DataFrame:
    """(part, n_documents, n_tokens, root) as the recipes have them now; a part streams through one task."""

    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for part, n, root in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = parts.setdefault(part, [0, 0, []])
                x[0] += 1
                x[1] += n
                x[2].append(root)
        for part, (documents, tokens, roots) in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([documents]), pa.array([tokens]), pa.array([merkle(roots)])], ["part", "n_documents", "n_tokens", "root"])

    ordered = spark.read.parquet(f"{path}/recipes").repartition("part").sortWithinPartitions("part", "start", "row")
    return ordered.select("part", "n_tokens", "root").mapInArrow(run, "part int, n_documents long, n_tokens long, root binary")


def checked_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, if the recipes are those that it names; else ValueError."""
    manifest = spark.read.parquet(f"{path}/manifest")
    kept = {r["part"]: r for r in manifest.collect()}
    for row in manifest_rows(spark, path).collect():
        if row["part"] not in kept or kept.pop(row["part"])["root"] != row["root"]:
            raise ValueError(f"part {row['part']} differs from its manifest")
    if kept:
        raise ValueError("the manifest has parts without recipes")
    return manifest


def verify(spark: SparkSession, path: str) -> int:
    """Compares the manifest with the recipes and every chunk with its hash; the number of tokens, or ValueError."""
    manifest = checked_manifest(spark, path)
    chunk_digests(spark, path).agg(F.count("*")).first()
    return sum(r["n_tokens"] for r in manifest.collect())


def chunk_digests(spark: SparkSession, path: str) -> DataFrame:
    """(hash, n, crc) of every stored chunk, read and verified; crc is that of its ids as little-endian 32-bit numbers."""
    import zlib

    def run(batches):
        for batch in batches:
            hashes, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for h, d in zip(hashes, data):
                if digest(d) != h:
                    raise ValueError(f"chunk {h.hex()} is damaged")
            ids = [unpack_ids(d) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], ["hash", "n", "crc"])

    return spark.read.parquet(f"{path}/chunks").select("hash", "data").mapInArrow(run, "hash binary, n int, crc long")


POLYNOMIAL = 0xEDB88320  # CRC-32, reversed: a fixed value


@lru_cache(maxsize=1)
def shifts() -> np.ndarray:
    """(32, 4, 256): what 2 ** k zero bytes behind a text make of each byte of its CRC (k, the byte's place, its value)."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(POLYNOMIAL), value >> 1)
    out = np.zeros((32, 4, 256), np.uint32)
    for place in range(4):
        one = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
        out[0, place] = (one >> np.uint32(8)) ^ (value[one & 255])
    for k in range(1, 32):
        for place in range(4):
            out[k, place] = apply(out[k - 1], out[k - 1, place])
    return out


def apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def crc_join(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRCs of two texts one behind the other, from their own and the second's size in bytes, elementwise."""
    out = first.astype(np.uint32)
    for k in range(int(size.max()).bit_length() if len(size) else 0):
        on = (size >> k) & 1 == 1
        out[on] = apply(shifts()[k], out[on])
    return out ^ second.astype(np.uint32)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored chunks by way of its recipe.

    The recipes are compared with the manifest. Each stored chunk is read once; recipes
    meet its verified digest, not its ids, and the digest of a document follows from those
    of its chunks in order. Recipes whose chunks or Merkle root don't agree raise an error.
    """
    manifest = F.broadcast(checked_manifest(spark, path).select("part", "base"))  # a row for each part
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("row", F.posexplode("chunks").alias("idx", "hash"))
    met = refs.join(chunk_digests(spark, path), "hash", "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("idx", "hash", "n", "crc"))).alias("found"))
    both = recipes.select("doc_id", "row", "part", "start", "n_tokens", "root").join(met, "row")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column(4)
            edge = found.offsets.to_numpy().astype(np.int64)
            flat = found.flatten()
            hashes, n, crc = flat.field("hash").to_pylist(), flat.field("n").fill_null(0).to_numpy().astype(np.int64), flat.field("crc").fill_null(0).to_numpy()
            at = edge - edge[0]
            for d, root in enumerate(batch.column(2).to_pylist()):
                if merkle(hashes[at[d] : at[d + 1]]) != root:
                    raise ValueError("a recipe's chunks don't rebuild its document")
            if (np.add.reduceat(n, at[:-1]) != batch.column(3).to_numpy()).any():
                raise ValueError("a recipe's chunks are missing or damaged")
            out, many = crc[at[:-1]].astype(np.uint32), np.diff(at)
            for k in range(1, int(many.max())):
                on = np.flatnonzero(many > k)
                out[on] = crc_join(out[on], crc[at[on] + k], 4 * n[at[on] + k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = both.join(manifest, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "root", "n_tokens", "found")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, row, ids): every document's ids as an array, put together from its chunks."""
    refs = spark.read.parquet(f"{path}/recipes").select("doc_id", "row", F.posexplode("chunks").alias("idx", "hash"))
    parts = refs.join(spark.read.parquet(f"{path}/chunks"), "hash").groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("idx", "data"))).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = [np.concatenate([unpack_ids(p["data"]).astype(np.int64) for p in row]) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "row", "ids"])

    return parts.mapInArrow(run, "doc_id long, row long, ids array<long>")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "store").path("tokens")
    write(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, path)
