"""Byte-level BPE by a shuffle of distinct words, and decoding by the token-byte table.

1. Groups of consecutive documents become their distinct pre-tokens and streams: for each
   block of documents the numbers of all its pre-tokens in order, which are their positions.
2. A group sends its words in one blob for each bucket of their hashes, so all groups'
   copies of a word stand together; it is encoded once and its ids go back to every group
   that has it. A word occurs once in a group at most, so no word, however frequent, makes a
   task much larger than others. Streams go with their group.
3. Ids and streams of a group meet, and each document's ids follow from its positions.

Texts are read and split once.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as V
from .common import labels

#: Bytes of text in a block; a group takes no further block beyond this many words; words of a bucket, about.
BLOCK, WORDS, BUCKET = 4 << 20, 400_000, 1 << 21


@lru_cache(maxsize=2)
def table(path: str) -> list[bytes]:
    """The bytes of every token, by id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines]
    out = [b""] * (1 + max(int(i) for _, i in pairs))
    for data, i in pairs:
        out[int(i)] = base64.b64decode(data)
    return out


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    if len(table(path)) > 1 << 16:
        raise ValueError(f"{path}: over 65,536 tokens")
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(table(path))}, special_tokens={})


SENT = "label int, bucket int, team long, home int, own boolean, data binary"
KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]


def _blob(sizes: np.ndarray, steps: np.ndarray, raw: bytes) -> bytes:
    """Words of a group: sizes, the steps from each one's number to the next, and what they hold."""
    head = V.pack(sizes, steps)
    return struct.pack("<I", len(head)) + head + zstandard.compress(raw, 2)


def _parts(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    (n,) = struct.unpack_from("<I", blob)
    return *V.unpack(blob[4 : 4 + n]), zstandard.decompress(blob[4 + n :])


def groups(docs: DataFrame, buckets: int, places: list[int]) -> DataFrame:
    """Rows SENT: a group's words by bucket, and its ``own`` streams; ``label`` and ``home`` name the partitions of bucket and group."""

    def run(batches):
        from pyspark import TaskContext

        part, made, known, streams = TaskContext.get().partitionId(), 0, {}, []

        def flush():
            nonlocal made, known, streams
            team, home = (part << 24) + made, places[(3 * part + made) % len(places)]
            words = pa.array(list(known), pa.string())
            bucket = ((V.string_hashes(words) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            edge = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
            data, offsets = V.text_bytes(words.take(pa.array(order)))
            out = [(places[team % len(places)], -1, team, home, True, s) for s in streams]
            for b in np.flatnonzero(np.diff(edge)).tolist():
                i, j = int(edge[b]), int(edge[b + 1])
                out.append((places[b % len(places)], b, team, home, False, _blob(np.diff(offsets[i : j + 1]), np.diff(order[i:j], prepend=0), data[offsets[i] : offsets[j]].tobytes())))
            made, known, streams = made + 1, {}, []
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 64]), KINDS)], ["label", "bucket", "team", "home", "own", "data"])

        for batch in batches:
            for few in V.slices(batch, limit=BLOCK):
                if len(known) > WORDS:
                    yield from flush()
                array, first, _ = V.pieces(few.column(1).to_pylist(), True)
                coded = array.dictionary_encode()
                number = np.array([known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()], "<i4")
                order = number[coded.indices.to_numpy(zero_copy_only=False)]
                planes = np.ascontiguousarray(order.view(np.uint8).reshape(-1, 4).T)  # like bytes of the numbers together
                ids = few.column(0)
                valid = ids.is_valid().to_numpy(zero_copy_only=False)
                head = np.array([len(known), few.num_rows, len(order)], "<i8").tobytes()
                streams.append(zstandard.compress(head + first.astype("<i8").tobytes() + ids.fill_null(0).to_numpy().astype("<i8").tobytes() + valid.tobytes() + planes.tobytes(), 9))
        if streams:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SENT)


def encode_words(sent: DataFrame, path: str, pattern: str) -> DataFrame:
    """(home, team, own, data): for each group its words' ids by bucket (16 bits each), and its streams as they are. A word is encoded once for all groups."""

    def run(batches):
        encode = encoding(path, pattern)._core_bpe.encode_single_piece
        now, held = None, []

        def flush():
            parts = [_parts(h[2]) for h in held]
            sizes = np.concatenate([p[0] for p in parts])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(b"".join(p[2] for p in parts))])
            coded = words.dictionary_encode()
            ids = list(map(encode, coded.dictionary.to_pylist()))
            many = np.fromiter(map(len, ids), np.int64, len(ids))
            values = np.fromiter(chain.from_iterable(ids), "<u2", int(many.sum()))
            which, begin, at, rows = coded.indices.to_numpy(zero_copy_only=False), np.cumsum(many) - many, 0, []
            for (home, team, _), (_, steps, _) in zip(held, parts):
                own = which[at : at + len(steps)]
                at += len(own)
                rows.append((home, team, False, _blob(many[own], steps, V.gather(own, many, values, begin).tobytes())))
            held.clear()
            return rows

        def out(rows):
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 256]), KINDS[3:4] + KINDS[2:3] + KINDS[4:])], ["home", "team", "own", "data"])

        for batch in batches:
            passed = []
            for bucket, team, home, own, data in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                if own:
                    passed.append((home, team, True, data))
                    continue
                if bucket != now:
                    if held:
                        yield from out(flush())
                    now = bucket
                held.append((home, team, data))
            yield from out(passed)
        if held:
            yield from out(flush())

    return sent.repartition("label").sortWithinPartitions("label", "bucket", "team").mapInArrow(run, "home int, team long, own boolean, data binary")


def assemble(answered: DataFrame) -> DataFrame:
    """(doc_id, ids): every document's ids, little-endian 16-bit; a group's ids stand before its streams."""

    def rebuild(stream: bytes, sizes: np.ndarray, begin: np.ndarray, values: np.ndarray):
        raw = zstandard.decompress(stream)
        n, rows, total = np.frombuffer(raw, "<i8", 3).tolist()
        if len(sizes) < n:
            raise ValueError("a group's words and streams don't fit")
        at = 24
        first = np.frombuffer(raw, "<i8", rows + 1, at)
        at += 8 * (rows + 1)
        docs = np.frombuffer(raw, "<i8", rows, at)
        at += 8 * rows
        valid = np.frombuffer(raw, bool, rows, at)
        at += rows
        order = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * total, at).reshape(4, -1).T).view("<i4").ravel()
        all_ids = V.gather(order, sizes, values, begin)
        edge = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64)[first]
        for i in range(0, rows, 512):
            j = min(i + 512, rows)
            data = [all_ids[edge[d] : edge[d + 1]].tobytes() for d in range(i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(docs[i:j], mask=~valid[i:j]), pa.array(data, pa.binary())], ["doc_id", "ids"])

    def known(answers):
        numbers, sizes, values = [], [], []
        for a in answers:
            size, steps, raw = _parts(a)
            numbers.append(np.cumsum(steps))
            sizes.append(size)
            values.append(raw)
        number, size = (np.concatenate([*c, np.zeros(0, np.int64)]) for c in (numbers, sizes))
        place = np.argsort(number)
        return size[place], (np.cumsum(size) - size)[place], np.frombuffer(b"".join(values), "<u2")

    def run(batches):
        now, answers, ready = None, [], None
        for batch in batches:
            for team, own, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if team != now:
                    now, answers, ready = team, [], None
                if not own:
                    answers.append(data)
                    continue
                if ready is None:
                    ready, answers = known(answers), []
                yield from rebuild(data, *ready)

    return answered.repartition("home").sortWithinPartitions("home", "team", "own").mapInArrow(run, "doc_id long, ids binary")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text): ids by the ranks at ``path``, little-endian 16-bit.

    Null and empty texts have no ids; rows with one id or none give a row each. Other
    columns are ignored. A vocabulary of over 65,536 tokens raises an error.
    """
    places = labels(docs.sparkSession)
    # As many buckets as partitions, or several for each where they would be large; about one distinct word in 50 bytes.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = len(places) * max(1, -(-size // (50 * BUCKET * len(places))))
    return assemble(encode_words(groups(docs, buckets, places), path, pattern))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data): the bytes that each row's ids stand for, by the table of tokens (of the vocabulary's fixed size)."""

    def run(batches):
        every = table(path)
        values = np.frombuffer(b"".join(every), np.uint8)
        sizes = np.array([len(x) for x in every], np.int64)
        begin = np.cumsum(sizes) - sizes
        for batch in batches:
            data = [V.gather(np.frombuffer(x.as_py(), "<u2"), sizes, values, begin).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.mapInArrow(run, "doc_id long, data binary")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids); decodes as ``decode`` does."""

    def run(batches):
        every = table(path)
        names = [str(i) for i in range(len(every))]
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for x in batch.column(1):
                ids = np.frombuffer(x.as_py(), "<u2").tolist()
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                out[2].append(hashlib.sha256(b"".join([every[i] for i in ids])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode(docs, path, public_tokenizers.PATTERN), path)
