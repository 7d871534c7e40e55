"""Array kernels over whole Arrow batches of text: words, hashes, shingles, pre-tokens.

Every kernel takes the texts of a slice of documents as one byte (or code point)
array with document offsets and works on all of them at once. Null texts count as
empty texts.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Slices end after this many bytes of text (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20

# Multipliers of the rolling and mixing hashes: fixed values.
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
SEED_2 = 0xD6E8FEB86659FD93
SEED_3 = 0xA0761D6478BD642F


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Yields consecutive row slices of ``batch`` of at most ``limit`` bytes of text, or one row."""
    n = batch.num_rows
    if not n:
        return
    offsets = text_offsets(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def text_offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes and len+1 offsets; null texts have no bytes."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = text_offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


# ---------------------------------------------------------------- words


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, lower


@lru_cache(maxsize=1)
def plain_separators() -> np.ndarray:
    """All ASCII bytes but letters and digits."""
    table = np.zeros(256, bool)
    table[:128] = [not chr(b).isalnum() for b in range(128)]
    return table


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _byte_tables()[1][data]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ``separators`` (0x20 and 0x09 to 0x0D): starts, ends, and each document's first word (len+1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~(_byte_tables()[0] if separators is None else separators)[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, for as many bytes as are hashed at once."""
    both = []
    for factor in (BASE, pow(BASE, -1, 1 << 64)):
        row = np.full(SLICE_BYTES + 1, factor, np.uint64)
        row[0] = 1
        both.append(np.cumprod(row))
    up, down = both
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def segments(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> list[int]:
    """Bounds of stretches of at most SLICE_BYTES that cut no word: after a separator or between documents; a longer word stays whole."""
    out, n = [0], len(data)
    while n - out[-1] > SLICE_BYTES:
        a, stop = out[-1], out[-1] + SLICE_BYTES
        gaps = np.flatnonzero(separators[data[a:stop]])
        cut = max(int(offsets[np.searchsorted(offsets, stop, side="right") - 1]), a + int(gaps[-1]) + 1 if len(gaps) else 0)
        if cut <= a:  # a word longer than a stretch
            gaps, later = separators[data[stop:]], offsets[offsets > stop]
            cut = min(stop + int(np.argmax(gaps)) + 1 if gaps.any() else n, int(later[0]) if len(later) else n)
        out.append(cut)
    return [*out, n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray | None = None):
    """(hashes, starts, ends, first) of all words, A-Z taken as a-z; equal words have equal hashes wherever they stand."""
    if len(data) <= SLICE_BYTES:
        return _word_hashes(data, offsets, separators)
    table = _byte_tables()[0] if separators is None else separators
    bounds = segments(data, offsets, table)
    hashes, starts, ends = [], [], []
    for a, b in zip(bounds, bounds[1:]):
        h, x, y, _ = _word_hashes(data[a:b], offsets[(offsets >= a) & (offsets <= b)] - a, separators)
        hashes.append(h)
        starts.append(x + a)
        ends.append(y + a)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets)


def _word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray | None):
    data = ascii_lower(data)
    starts, ends, first = words(data, offsets, separators)
    n = len(data)
    if n > SLICE_BYTES:  # one word of that length
        whole = np.array([int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest(), "little") for a, b in zip(starts, ends)], np.uint64)
        return whole, starts, ends, first
    up, down = _powers()
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(SEED_2)), starts, ends, first


def string_hashes(column: pa.Array) -> np.ndarray:
    """A hash of each string's bytes; equal strings have equal hashes."""
    data, offsets = text_bytes(column)
    up, down = _powers()
    out, i = np.zeros(len(column), np.uint64), 0
    while i < len(column):
        j = max(int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1, i + 1)
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(own) > SLICE_BYTES:  # one string of that length
            out[i] = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little")
        else:
            prefix = np.zeros(len(own) + 1, np.uint64)
            np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)], out=prefix[1:])
            out[i:j] = mix((prefix[at[1:]] - prefix[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(SEED_2))
        i = j
    return out


def join_hash(*parts: np.ndarray) -> np.ndarray:
    """A hash of an ordered tuple of hashes, elementwise."""
    out = np.full(len(parts[0]), SEED_3, np.uint64)
    for part in parts:
        out = mix(out * np.uint64(BASE) + part)
    return out


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-word shingle and each document's first shingle (len+1).

    A document with fewer than k words but at least one has its whole sequence as one.
    """
    counts = np.diff(first)
    n_sh = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    edge = np.concatenate([[0], np.cumsum(n_sh)]).astype(np.int64)
    total = int(edge[-1])
    if not total:
        return np.zeros(0, np.uint64), edge
    owner = np.repeat(np.arange(len(counts)), n_sh)
    at = np.arange(total) - edge[owner] + first[owner]
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = join_hash(*(padded[at + j] for j in range(k)))
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        out[edge[d]] = join_hash(*(hashes[j : j + 1] for j in range(first[d], first[d + 1])))[0] ^ np.uint64(counts[d])
    return out, edge


# ---------------------------------------------------------------- pre-tokens

LETTER, NUMBER, SPACE = 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or none of them."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        found = "".join(regex.findall(pattern, every))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


#: What may follow an apostrophe in a piece of its own: fixed values of the public patterns.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def _apostrophes(points: np.ndarray, kinds: np.ndarray, begins: np.ndarray, alone: np.ndarray) -> None:
    """Moves the piece starts behind the apostrophes ``alone`` (that begin a piece of one character)."""
    n = len(points)
    for i in alone[alone + 1 < n]:
        if begins[i + 1] and kinds[i + 1] == LETTER and not begins[i + 1] == 2:
            a = chr(points[i + 1])
            size = 1 if a in ONE_LETTER else 0
            if not size and i + 2 < n and not begins[i + 2]:
                size = 2 if a + chr(points[i + 2]) in TWO_LETTERS else 0
            if size:
                begins[i + 1] = 0
                if i + 1 + size < n and not begins[i + 1 + size]:
                    begins[i + 1 + size] = 1


def pieces(text: list[str], leading_space: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Splits texts into the pieces that byte-pair merges stay within.

    With ``leading_space``, pieces are those of the byte-level pattern: they cover the
    text, and a piece of letters, numbers or signs takes one blank before it. Without,
    they are the word pattern's: letters, single numbers, runs of signs, no white space.

    Returns the pieces, each document's first piece (len+1) and which pieces are kept.
    """
    points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
    n = len(points)
    edge = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(text) + 1, np.int64), np.zeros(0, bool)
    kinds = classes()[points]
    begins = np.zeros(n + 1, np.uint8)  # 2: a document starts
    begins[1:n] = kinds[1:] != kinds[:-1]
    if not leading_space:
        begins[1:n] |= kinds[1:] == NUMBER
    begins[edge] = 2
    begins = begins[:n]
    sign = np.flatnonzero((points == 39) & (begins > 0))
    if leading_space:
        # White space before other text: its last character is a piece of its own or a blank that joins what follows.
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (begins[1:] != 2))
        begins[last] = np.maximum(begins[last], 1)
        blank = points[last] == 32
        begins[last[blank] + 1] = 0
        sign = sign[begins[sign] > 0]
    _apostrophes(points, kinds, begins, sign)
    starts = np.flatnonzero(begins)
    data = "".join(text).encode()
    if len(data) == n:
        at = np.append(starts, n)
    else:
        wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(wide)])[np.append(starts, n)]
    array = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    return array, np.searchsorted(starts, edge), kinds[starts] != SPACE


def gather(order: np.ndarray, lengths: np.ndarray, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Concatenates values[begin[k] : begin[k] + lengths[k]] for k in order."""
    size = lengths[order]
    total = int(size.sum())
    if not total:
        return values[:0]
    shift = np.repeat(begin[order] - (np.cumsum(size) - size), size)
    return values[shift + np.arange(total)]


# ---------------------------------------------------------------- columns of numbers as bytes


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers as bytes: of each its least, then the others' distance from it, like bytes together, in as few bytes as the largest needs."""
    out = [bytes([len(columns)])]
    for c in columns:
        c = np.ascontiguousarray(c, np.int64)
        n, least = len(c), int(c.min()) if len(c) else 0
        away = c.view(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF)  # the difference of two longs fits an unsigned one
        width = (int(away.max()).bit_length() + 7) // 8 if n else 0
        out += [struct.pack("<IBq", n, width, least), np.ascontiguousarray(away.view(np.uint8).reshape(n, 8)[:, :width].T).tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        n, width, least = struct.unpack_from("<IBq", data, at)
        at += 13
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        out.append((full.view("<u8")[:, 0] + np.uint64(least & 0xFFFFFFFFFFFFFFFF)).view(np.int64))
    return out
