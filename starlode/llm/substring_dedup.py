"""Substring dedup by collinear chaining: finds passages that documents share, edits included.

1. Seeds: the hashes of all k-word runs. Documents are read in chunks of about ``chunk`` words; a
   chunk sends each of its distinct seeds once, in one blob for each bucket of hashes, so a seed that
   stands everywhere comes once a chunk, however many documents hold it. At k = 4, ``min_words`` = 50
   and ``similarity`` = 0.8 a passage shares at least ``shared`` = 7 seeds with its source: a change
   breaks k of them at most (q-gram lemma).
2. A bucket answers each chunk: for every seed that stands earlier, its first occurrence (smallest
   document, then position), which is the one that stays. A seed of any number of documents
   therefore makes as many matches, not all pairs, and no bucket or chunk grows with its frequency.
3. The chunk chains the matches of two documents in order: a match adds its weight and pays for the
   words between it and the match before; a Fenwick tree over the first document's positions gives
   the best predecessor. A chain needs ``least`` matches: up to ``shared - least`` seeds of the
   shortest, most changed passage may have their first occurrence elsewhere.
4. Chains whose two stretches share ``shared`` seeds, as a passage must, are aligned word by word,
   their ends extended, and their stretches of at least ``similarity`` stay. The passages of a
   document are the unions of its aligned stretches that reach ``min_words``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as V
from .bloom import Table, table_of
from .common import Scratch, labels, settle
from .textvec import pack, unpack


@dataclass(frozen=True)
class Settings:
    """k: words of a seed. least: matches of a chain. max_gap: words between two matches of a chain. extend: words tried beyond a chain's ends.
    min_chain: words of an aligned stretch that counts towards a passage. chunk: words whose seeds are sent together. bucket: seeds matched together, about.
    stride: matches of one diagonal of which one is chained. inside: whether a document's own repeats count."""

    k: int = 4
    min_words: int = 50
    similarity: float = 0.8
    least: int = 4
    weight: float = 6.0
    gap_cost: float = 0.05
    max_gap: int = 40
    extend: int = 48
    min_chain: int = 12
    chunk: int = 1 << 20
    bucket: int = 1 << 21
    stride: int = 8
    inside: bool = False

    @property
    def shared(self) -> int:
        changes = int(self.min_words * (1 - self.similarity) + 1e-9)
        return max(self.min_words - self.k + 1 - self.k * changes, 1)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, tag, text) of the rows with an id: row tells rows apart and is the same at every scan of a table, tag is the text's CRC-32."""
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.crc32("text").alias("tag"), "text")


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on (len - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * np.uint64(pow(V.BASE, 2 * j + 1, 1 << 64))
    return V.mix(total)


def sorted_by(*columns: np.ndarray) -> np.ndarray:
    """The order by the columns (non-negative integers), the first one most significant."""
    widths = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    place = max(len(columns[0]) - 1, 1).bit_length()
    if sum(widths) + place > 64:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.uint64)
    for c, w in zip(columns, widths):
        key = (key << np.uint64(w)) | c.astype(np.uint64)
    key = np.sort((key << np.uint64(place)) | np.arange(len(key), dtype=np.uint64))
    return (key & np.uint64((1 << place) - 1)).astype(np.int64)


SENT = "label int, bucket int, chunk long, home int, own boolean, data binary"


def seeds(docs: DataFrame, s: Settings, buckets: int, places: list[int]) -> DataFrame:
    """The blobs of all chunks: for each bucket (key, pos, doc, count, id, tag, row) and one of its ``own`` (row, id, tag and its repeats).

    A bucket goes to the partition of ``label``, a chunk comes back to that of ``home``.
    """

    def run(batches):
        from pyspark import TaskContext

        part, made, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []  # (row, id, tag, first position, seeds)

        def flush():
            nonlocal made, size, held
            rows, ids, tags, starts = (np.array([x[i] for x in held], np.int64) for i in range(4))
            order = np.lexsort((rows, tags, ids))
            rows, ids, tags, starts = rows[order], ids[order], tags[order], starts[order]
            h = np.concatenate([held[i][4] for i in order.tolist()])
            sizes = np.array([len(held[i][4]) for i in order.tolist()])
            doc = np.repeat(np.arange(len(rows)), sizes)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)
            bucket, key = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
            at = sorted_by(bucket, key)
            again = (bucket[at[1:]] == bucket[at[:-1]]) & (key[at[1:]] == key[at[:-1]])
            new = np.append(True, ~again)
            first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
            later, source = at[~new], first[~new]
            chunk, home = (part << 24) + made, places[(5 * part + made) % len(places)]
            out = [(places[chunk % len(places)], -1, chunk, home, True, pack(rows, ids, tags, doc[later], pos[later], doc[source], pos[source]))]
            once = np.sort(at[new])
            order = once[np.argsort(bucket[once].astype(np.uint16) if buckets <= 1 << 16 else bucket[once], kind="stable")]
            edge = np.concatenate([[0], np.cumsum(np.bincount(bucket[order], minlength=buckets))])
            key, pos, doc = key[order], pos[order], doc[order]
            for b in np.flatnonzero(np.diff(edge)).tolist():
                i, j = int(edge[b]), int(edge[b + 1])
                here = np.flatnonzero(np.append(True, np.diff(doc[i:j]) > 0))
                there, count = doc[i:j][here], np.diff(np.append(here, j - i))
                out.append((places[b % len(places)], b, chunk, home, False, pack(key[i:j], pos[i:j], there, count, ids[there], tags[there], rows[there])))
            made, size, held = made + 1, 0, []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 64]), kinds)], ["label", "bucket", "chunk", "home", "own", "data"])

        for batch in batches:
            for few in V.slices(batch):
                hashes, _, _, first = V.word_hashes(*V.text_bytes(few.column(3)))
                row, doc, tag = (few.column(i).to_numpy().tolist() for i in range(3))
                every = grams(hashes, s.k)
                for d in np.flatnonzero(np.diff(first) >= s.k).tolist():
                    a, b = int(first[d]), int(first[d + 1]) - s.k + 1
                    # A very long document comes in several chunks.
                    for i in range(a, b, s.chunk):
                        own = every[i : min(i + s.chunk, b)]
                        held.append((row[d], doc[d], tag[d], i - a, own))
                        size += len(own)
                        if size >= s.chunk:
                            yield from flush()
        if held:
            yield from flush()

    return numbered(docs).mapInArrow(run, SENT)


def first_matches(blobs: list[bytes], inside: bool) -> tuple[np.ndarray, ...]:
    """(blob, doc, pos, a_row, a_pos): each entry of a bucket's blobs that has an earlier one with its key, and the earliest, in another document or at another place."""
    key, pos, doc, count, ids, tags, rows = (list(c) for c in zip(*(unpack(b) for b in blobs)))
    docs_of = np.repeat(np.arange(len(blobs)), [len(d) for d in doc])
    count, blob = np.concatenate(count), np.repeat(np.arange(len(blobs)), [len(k) for k in key])
    key, pos, doc, ids, tags, rows = (np.concatenate(c) for c in (key, pos, doc, ids, tags, rows))
    which = np.repeat(np.arange(len(doc)), count)
    order = sorted_by(key)
    same = key[order[1:]] == key[order[:-1]]
    held = order[np.append(same, False) | np.append(False, same)]  # keys of several chunks
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((docs_of, rows, tags, ids))] = np.arange(len(doc))
    held = held[sorted_by(key[held], rank[which[held]], pos[held])]
    new = np.append(True, key[held[1:]] != key[held[:-1]])[: len(held)]
    top = held[np.flatnonzero(new)[np.cumsum(new) - 1]]
    x, a = which[held], which[top]
    own = (ids[x] == ids[a]) & (tags[x] == tags[a])
    keep = ~new & (~own | (inside & (pos[held] > pos[top])))
    held, top = held[keep], top[keep]
    return blob[held], doc[which[held]], pos[held], rows[which[top]], pos[top]


def matches(sent: DataFrame, s: Settings) -> DataFrame:
    """(home, chunk, own, data): the buckets' answers to each chunk (doc, pos, a_row, a_pos), and the chunks' own rows as they are."""

    def run(batches):
        now, held = None, []

        def flush():
            blob, *found = first_matches([h[2] for h in held], s.inside)
            order = np.argsort(blob, kind="stable")
            edge = np.searchsorted(blob[order], np.arange(len(held) + 1)).tolist()
            rows = [(held[i][0], held[i][1], False, pack(*(c[order[edge[i] : edge[i + 1]]] for c in found))) for i in range(len(held)) if edge[i] < edge[i + 1]]
            held.clear()
            return rows

        def out(rows):
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 256]), [pa.int32(), pa.int64(), pa.bool_(), pa.binary()])], ["home", "chunk", "own", "data"])

        for batch in batches:
            passed = []
            for bucket, chunk, home, own, data in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                if own:
                    passed.append((home, chunk, True, data))
                    continue
                if bucket != now:
                    if held:
                        yield from out(flush())
                    now = bucket
                held.append((home, chunk, data))
            yield from out(passed)
        if held:
            yield from out(flush())

    return sent.repartition("label").sortWithinPartitions("label", "bucket", "chunk").mapInArrow(run, "home int, chunk long, own boolean, data binary")


def merged(own: bytes, answers: list[bytes], s: Settings) -> tuple[np.ndarray, ...]:
    """(rows, ids, tags, doc, pos, a_row, a_pos): a chunk's documents and all matches of its seeds, repeats within the chunk included, in the order of doc, a_row and pos."""
    rows, ids, tags, later, later_pos, source, source_pos = unpack(own)
    doc, pos, a_row, a_pos = (np.concatenate(c) for c in zip(*map(unpack, answers))) if answers else [np.zeros(0, np.int64)] * 4
    if len(later):
        # A repeat has the match of the chunk's first one, or that one itself.
        place = (doc << 32) | pos
        order = np.argsort(place)
        wanted = (source << 32) | source_pos
        at = order[np.minimum(np.searchsorted(place, wanted, sorter=order), len(place) - 1)] if len(place) else np.zeros(len(wanted), np.int64)
        hit = place[at] == wanted if len(place) else np.zeros(len(wanted), bool)
        partner, partner_pos = rows[source].copy(), source_pos.copy()
        partner[hit], partner_pos[hit] = a_row[at[hit]], a_pos[at[hit]]
        alike = (ids[source] == ids[later]) & (tags[source] == tags[later]) & ~hit
        keep = ~alike | (s.inside & (later_pos > source_pos))
        doc, pos, a_row, a_pos = (np.concatenate([x, y[keep]]) for x, y in ((doc, later), (pos, later_pos), (a_row, partner), (a_pos, partner_pos)))
    _, partner = np.unique(a_row, return_inverse=True)
    order = sorted_by(doc, partner, pos) if len(doc) else np.zeros(0, np.int64)
    return rows, ids, tags, doc[order], pos[order], a_row[order], a_pos[order]


def close_groups(doc: np.ndarray, a_row: np.ndarray, pos: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of the stretches of matches of two documents without a gap that ends a chain, of ``least`` matches or more."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (a_row[1:] != a_row[:-1]) | (np.diff(pos) > s.max_gap + s.k)))
    stop = np.append(start[1:], len(doc))
    enough = stop - start >= s.least
    return start[enough], stop[enough]


def chain(b: list[int], a: list[int], s: Settings) -> list[list[int]]:
    """Collinear chains of the matches (b ascending; ties by a): lists of match numbers.

    f(i) = weight + max(0, max f(j) - gap_cost * (b_i - b_j + a_i - a_j)) over j before i in
    both texts. f(j) + gap_cost * (b_j + a_j) doesn't depend on i, so a Fenwick tree of
    prefix maxima over the ranks of a answers it.
    """
    n = len(b)
    rank = {v: r + 1 for r, v in enumerate(sorted(set(a)))}
    size = len(rank)
    best, who = [-1e18] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and b[j] == b[i]:  # one place of b at a time: its matches can't precede each other
            top, from_ = -1e18, -1
            r = rank[a[j]] - 1
            while r > 0:
                if best[r] > top:
                    top, from_ = best[r], who[r]
                r -= r & -r
            gain = top - s.gap_cost * (b[j] + a[j])
            score[j], before[j] = (s.weight + gain, from_) if gain > 0 else (s.weight, -1)
            j += 1
        for t in range(i, j):
            value, r = score[t] + s.gap_cost * (b[t] + a[t]), rank[a[t]]
            while r <= size:
                if value > best[r]:
                    best[r], who[r] = value, t
                r += r & -r
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda t: -score[t]):
        path = []
        while end >= 0 and not used[end]:
            used[end] = True
            path.append(end)
            end = before[end]
        if path:
            path.reverse()
            cut = 0
            for t in range(1, len(path)):
                if max(b[path[t]] - b[path[t - 1]], a[path[t]] - a[path[t - 1]]) > s.max_gap + s.k:
                    out.append(path[cut:t])
                    cut = t
            out.append(path[cut:])
    return out


def blocks(b: list[int], a: list[int], path: list[int], k: int) -> list[int]:
    """A chain as runs of one diagonal: flat (b start, a start, length)."""
    out: list[int] = []
    for t in path:
        if out and a[t] - b[t] == out[-2] - out[-3]:
            out[-1] = b[t] + k - out[-3]
        else:
            if out:  # the run before must not reach into this one
                over = max(out[-3] + out[-1] - b[t], out[-2] + out[-1] - a[t], 0)
                out[-1] = max(out[-1] - over, 1)
            out += [b[t], a[t], k]
    return out


def chains(answered: DataFrame, s: Settings) -> DataFrame:
    """(row, doc_id, tag, a_row, runs) of the chains; a chunk's matches stand in one task."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["row", "doc_id", "tag", "a_row", "runs"]

    def linked(own, answers):
        rows, ids, tags, doc, pos, a_row, a_pos = merged(own, answers, s)
        start, stop = close_groups(doc, a_row, pos, s)
        if not len(start):
            return
        # Matches on one diagonal are a chain as they stand.
        away, bounds = np.append(a_pos - pos, 0), np.stack([start, stop], 1).ravel()
        straight = np.minimum.reduceat(away, bounds)[::2] == np.maximum.reduceat(away, bounds)[::2]
        at, end = start[straight], stop[straight] - 1
        runs = np.stack([pos[at], a_pos[at], pos[end] + s.k - pos[at]], 1).ravel().astype(np.int32)
        d = doc[at]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * 3), pa.array(runs))
        yield pa.RecordBatch.from_arrays([pa.array(rows[d]), pa.array(ids[d]), pa.array(tags[d]), pa.array(a_row[at]), lists], names)
        # Of matches that follow each other word by word the first, the last and some between: the same stretch.
        goes_on = (doc[1:] == doc[:-1]) & (a_row[1:] == a_row[:-1]) & (np.diff(pos) == 1) & (np.diff(a_pos) == 1)
        begins = np.append(True, ~goes_on)
        number = np.arange(len(pos)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        kept = np.flatnonzero((number % s.stride == 0) | np.append(~goes_on, True))
        stands_for = np.diff(np.append(kept, len(pos)))
        out: list[tuple] = []
        for i, j in zip(np.searchsorted(kept, start[~straight]).tolist(), np.searchsorted(kept, stop[~straight]).tolist()):
            own_at = kept[i:j]
            x, y, n, d = pos[own_at].tolist(), a_pos[own_at].tolist(), stands_for[i:j].tolist(), int(doc[own_at[0]])
            for path in chain(x, y, s):
                if sum(n[t] for t in path) >= s.least:
                    out.append((int(rows[d]), int(ids[d]), int(tags[d]), int(a_row[own_at[0]]), blocks(x, y, path, s.k)))
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 10_000]), kinds)], names)

    def run(batches):
        now, own, answers = None, None, []
        for batch in batches:
            for chunk, mine, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if chunk != now:
                    if own is not None:
                        yield from linked(own, answers)
                    now, own, answers = chunk, None, []
                if mine:
                    own = data
                else:
                    answers.append(data)
        if own is not None:
            yield from linked(own, answers)

    return answered.repartition("home").sortWithinPartitions("home", "chunk").mapInArrow(run, "row long, doc_id long, tag long, a_row long, runs array<int>")


def word_rows(docs: DataFrame, wanted: Table) -> DataFrame:
    """(row, doc_id, tag, words): 16-bit word hashes of the rows in the table ``wanted``; one pair of different words in 65,536 looks alike to an alignment."""
    shared = wanted.shared(docs.sparkSession)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(shared.value.holds(batch.column(0).to_numpy())))
            for part in V.slices(batch):
                hashes, _, _, first = V.word_hashes(*V.text_bytes(part.column(3)))
                short = (hashes >> np.uint64(48)).astype("<u2")
                data = [short[first[d] : first[d + 1]].tobytes() for d in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(data, pa.binary())], ["row", "doc_id", "tag", "words"])

    return numbered(docs).mapInArrow(run, "row long, doc_id long, tag long, words binary")


def edits(x: list[int], y: list[int]) -> int:
    """Words changed, put in or left out between x and y."""
    if len(x) == len(y):
        apart = sum(u != v for u, v in zip(x, y))
        if apart <= 2:  # words put in and left out would be as many
            return apart
    row = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
    return row[-1]


def heaviest(alike: np.ndarray, changed: np.ndarray, cost: int) -> tuple[int, int]:
    """The stretch (start, stop) in which words alike outweigh the changed ones, of ``cost`` each, by most."""
    total = np.concatenate([[0], np.cumsum(alike - cost * changed)])
    gain = total - np.minimum.accumulate(total)
    stop = int(np.argmax(gain))
    return int(np.argmin(total[: stop + 1])), stop


def longest(alike: np.ndarray, changed: np.ndarray, cost: int) -> tuple[int, int]:
    """The longest stretch (start, stop) between words alike in which they outweigh or match the changed ones, of ``cost`` each."""
    total = np.concatenate([[0], np.cumsum(alike - cost * changed)])
    least = np.minimum.accumulate(np.where(alike > 0, total[:-1], 1 << 40))
    stops = np.flatnonzero(alike > 0) + 1
    if not len(stops):
        return 0, 0
    starts = np.searchsorted(-least, -total[stops])
    k = int(np.argmax(stops - starts))
    return int(starts[k]), int(stops[k])


def diagonal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Columns (words alike, words changed, words of x, words of y) of two stretches word against word, as far as the shorter goes."""
    n = min(len(x), len(y))
    same = (x[:n] == y[:n]).astype(np.int64)
    return np.stack([same, 1 - same, np.ones_like(same), np.ones_like(same)])


def shifted(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[np.ndarray]:
    """For each pair (x, y) the columns of their alignment with the fewest changes, up to the end of one of them; all pairs at once."""
    n, most = len(xs), max((len(v) for v in (*xs, *ys)), default=0)
    many = np.arange(n)
    lx, ly = (np.array([len(v) for v in side]) for side in (xs, ys))
    x, y = np.full((n, most), -1, np.int64), np.full((n, most), -2, np.int64)
    for i in range(n):
        x[i, : lx[i]], y[i, : ly[i]] = xs[i], ys[i]
    table, at = np.zeros((n, most + 1, most + 1), np.int16), np.arange(most + 1, dtype=np.int16)
    table[:, 0] = at
    for i in range(most):
        row, last = table[:, i + 1], table[:, i]
        row[:, 0] = i + 1
        row[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + (x[:, i, None] != y))
        row[:] = np.minimum.accumulate(row - at, axis=1) + at  # words of y left out
    # The end with the fewest changes, the farthest of equals.
    down, across = table[many, lx], table[many, :, ly]
    score = np.concatenate([np.where(at <= ly[:, None], down * 256 - lx[:, None] - at, 1 << 20), np.where(at <= lx[:, None], across * 256 - ly[:, None] - at, 1 << 20)], axis=1)
    end = score.argmin(axis=1)
    i, j = np.where(end <= most, lx, end - most - 1), np.where(end <= most, end, ly)
    kinds, steps = np.zeros((n, 2 * most + 1), np.int8), np.zeros(n, np.int64)  # 1: alike, 2: changed, 3: a word of x alone, 4: of y
    while (on := np.flatnonzero((i > 0) | (j > 0))).size:
        u, v = i[on], j[on]
        here, p, q = table[on, u, v], np.maximum(u - 1, 0), np.maximum(v - 1, 0)
        differ = x[on, p] != y[on, q]
        both = (u > 0) & (v > 0) & (here == table[on, p, q] + differ)
        alone = ~both & (u > 0) & (here == table[on, p, v] + 1)
        kinds[on, steps[on]] = np.where(both, 1 + differ, np.where(alone, 3, 4))
        i[on], j[on] = np.where(both | alone, p, u), np.where(both | ~alone, q, v)
        steps[on] += 1
    parts = np.array([[0, 1, 0, 0, 0], [0, 0, 1, 1, 1], [0, 1, 1, 1, 0], [0, 1, 1, 0, 1]], np.int64)
    return [parts[:, kinds[k, : steps[k]][::-1]] for k in range(n)]


def stretches(columns: np.ndarray, b0: int, a0: int, s: Settings) -> list[tuple[int, int, int, int, float]]:
    """b's and a's bounds and the similarity of the stretches of an alignment that are similar enough."""
    same, changed, nb, na = columns
    at_b, at_a, at_e = (np.concatenate([[0], np.cumsum(n)]) + v for n, v in ((nb, b0), (na, a0), (changed, 0)))
    cost = round(s.similarity / (1 - s.similarity))  # of a change, at which a stretch can't fall below the similarity

    def take(i, j):
        words = max(at_b[j] - at_b[i], at_a[j] - at_a[i])
        similarity = 1.0 - (at_e[j] - at_e[i]) / max(words, 1)
        return (int(at_b[i]), int(at_b[j]), int(at_a[i]), int(at_a[j]), float(similarity)), similarity >= s.similarity - 1e-9

    out, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        # At a cost of 3 a stretch ends where it should but may fall below the similarity.
        for weight in (3, cost):
            i, j = (v + lo for v in heaviest(same[lo:hi], changed[lo:hi], weight))
            if max(at_b[j] - at_b[i], at_a[j] - at_a[i]) < s.min_chain:
                break
            found, fits = take(i, j)
            if fits:
                if found[1] - found[0] >= s.min_chain:
                    out.append(found)
                todo += [(lo, i), (j, hi)]
                break
    if size(out) < s.min_words:
        # A passage whose ends are changed so much that its heaviest stretch is too short for one.
        found, fits = take(*longest(same, changed, cost))
        if fits and found[1] - found[0] >= s.min_words:
            return [found]
    return out


def size(found: list[tuple[int, int, int, int, float]]) -> int:
    return max((x[1] - x[0] for x in found), default=0)


def common(b: list[np.ndarray], a: list[np.ndarray], k: int) -> np.ndarray:
    """For each pair of stretches, the places of the first whose k words stand somewhere in the second."""

    def hashes(stretches):
        sizes = np.array([len(x) for x in stretches], np.int64)
        owner = np.repeat(np.arange(len(stretches)), sizes)
        h = grams(np.concatenate(stretches).astype(np.uint64), k)
        inside = owner[k - 1 :] == owner[: len(h)]
        owner = owner[: len(h)][inside]
        return V.mix(h[inside] + owner.astype(np.uint64) * np.uint64(V.SEED_2)), owner

    (x, owner), (y, _) = hashes(b), hashes(a)
    if not len(x) or not len(y):
        return np.zeros(len(b), np.int64)
    y = np.sort(y)
    return np.bincount(owner[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x], minlength=len(b))


def core(b: np.ndarray, a: np.ndarray, runs: list[list[int]]) -> np.ndarray:
    """The columns of two stretches from the first run of a chain to the last; what stands between two runs is one column."""
    out, ends = [], runs[0][:2]
    for bi, ai, n in runs:
        x, y = b[ends[0] : bi].tolist(), a[ends[1] : ai].tolist()
        if x or y:
            d = edits(x, y)
            out.append(np.array([[max(len(x), len(y)) - d], [d], [len(x)], [len(y)]]))
        out.append(diagonal(b[bi : bi + n], a[ai : ai + n]))
        ends = [bi + n, ai + n]
    return np.concatenate(out, axis=1)


def align(b: list[np.ndarray], a: list[np.ndarray], chains: list[list[list[int]]], s: Settings) -> list[list[tuple[int, int, int, int, float]]]:
    """Aligns pairs of stretches along their chains (runs relative to them) and beyond their ends: b's and a's bounds and the similarity of what is similar enough."""
    out, cores, left, right = [], [], [], []
    for x, y, runs in zip(b, a, chains):
        (b0, a0, _), (b1, a1, n) = runs[0], runs[-1]
        cores.append(core(x, y, runs))
        left.append((x[:b0][::-1][: s.extend], y[:a0][::-1][: s.extend]))
        right.append((x[b1 + n :][: s.extend], y[a1 + n :][: s.extend]))

    def found(i, before, after):
        columns = np.concatenate([before[:, ::-1], cores[i], after], axis=1)
        if columns[0].sum() < s.min_chain * s.similarity:
            return []
        return stretches(columns, chains[i][0][0] - int(before[2].sum()), chains[i][0][1] - int(before[3].sum()), s)

    for i in range(len(b)):
        out.append(found(i, diagonal(*left[i]), diagonal(*right[i])))
    # Words put in or left out near the ends.
    short = [i for i in range(len(b)) if size(out[i]) < s.min_words]
    if short:
        before, after = (shifted(*zip(*[side[i] for i in short])) for side in (left, right))
        for i, x, y in zip(short, before, after):
            more = found(i, x, y)
            if size(more) >= s.min_words:
                out[i] = more
    return out


ALIGNED = "doc_id long, tag long, start int, stop int, a_doc long, a_tag long, a_start int, a_stop int, similarity double"


def aligned(found: DataFrame, words: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, tag, start, stop, a_doc, a_tag, a_start, a_stop, similarity) of the chains that are similar enough."""
    last = F.size("runs")
    c = found.select(
        "row", "doc_id", "tag", "a_row", "runs",
        F.greatest(F.col("runs")[0] - s.extend, F.lit(0)).alias("b0"), (F.col("runs")[last - 3] + F.col("runs")[last - 1] + s.extend).alias("b1"),
        F.greatest(F.col("runs")[1] - s.extend, F.lit(0)).alias("a0"), (F.col("runs")[last - 2] + F.col("runs")[last - 1] + s.extend).alias("a1"),
    )

    def cut(column, start, stop):
        return F.substring(column, F.col(start) * 2 + 1, (F.col(stop) - F.col(start)) * 2)

    # The sources first: many chains may lead to one, and are aligned where their own documents stand.
    sides = words.select(F.col("row").alias("a_row"), F.col("doc_id").alias("a_doc"), F.col("tag").alias("a_tag"), "words")
    c = c.join(sides, "a_row").withColumn("a", cut("words", "a0", "a1")).drop("words")
    c = c.join(words.select("row", "words"), "row").withColumn("b", cut("words", "b0", "b1")).drop("words")
    names = [f.split()[0] for f in ALIGNED.split(", ")]

    def run(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            b, a = ([np.frombuffer(x, "<u2") for x in batch.column(i).to_pylist()] for i in (7, 8))
            doc, tag, a_doc, a_tag, b0, a0 = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6))
            # A stretch with a passage shares as many seeds with its source as the lemma says.
            likely = np.flatnonzero(common(b, a, s.k) >= s.shared).tolist()
            runs = [(np.array(batch.column(4)[i].as_py(), np.int64).reshape(-1, 3) - np.array([b0[i], a0[i], 0])).tolist() for i in likely]
            rows = [(doc[i], tag[i], x[0] + b0[i], x[1] + b0[i], a_doc[i], a_tag[i], x[2] + a0[i], x[3] + a0[i], x[4]) for i, found in zip(likely, align([b[i] for i in likely], [a[i] for i in likely], runs, s)) for x in found]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(9)], names)

    return c.select("doc_id", "tag", "a_doc", "a_tag", "runs", "b0", "a0", "b", "a").mapInArrow(run, ALIGNED)


def united(spans: DataFrame, keys: tuple[str, ...], s: Settings) -> DataFrame:
    """``spans`` (keys, start, stop) with ``run``, the number of the union of overlapping or touching ones that each belongs to."""
    inside = W.partitionBy(*keys).orderBy("start", "stop")
    so_far = F.max("stop").over(inside.rowsBetween(W.unboundedPreceding, -1))
    new = spans.withColumn("new", (F.col("start") > F.coalesce(so_far, F.lit(-1))).cast("int"))
    return new.withColumn("run", F.sum("new").over(inside.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def passages(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, tag, start, stop, a_doc, a_tag, a_start, a_stop, similarity): each document's repeated passages, in words.

    ``start`` to ``stop`` is the union of aligned chains with smaller documents, or with
    earlier places of the same one; the rest describes the longest of them. Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Null and empty texts and documents below
    min_words have no passages. Rows with a null id are left out. Rows that share an id are
    documents of their own if their texts differ (tag is a text's CRC-32), one document if
    not. Other columns are ignored. ``docs`` has to give the same rows at every scan.
    """
    s = settings
    scratch = scratch or Scratch(spark, "substring")
    docs = docs.select("doc_id", "text")
    places = labels(spark)
    # As many buckets as partitions, or several for each where they would be large; a word has five bytes or more on average.
    words = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = len(places) * max(1, -(-words // (5 * s.bucket * len(places))))
    linked = scratch.keep(chains(matches(seeds(docs, s, buckets, places), s), s), "chains")
    settle(spark)
    wanted = table_of(linked.select("row").union(linked.select("a_row")))
    held = scratch.keep(word_rows(docs, wanted), "words", "lz4")
    good = scratch.keep(aligned(linked, held, s), "aligned")
    scratch.drop("words", "chains")
    settle(spark)
    # A document's own stretches, so as many as its words allow.
    runs = united(good, ("doc_id", "tag"), s)
    longest = F.max(F.struct(F.col("stop") - F.col("start"), -F.col("a_doc"), "a_doc", "a_tag", "a_start", "a_stop", "similarity")).alias("x")
    found = runs.groupBy("doc_id", "tag", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), longest)
    return found.where(F.col("stop") - F.col("start") >= s.min_words).select("doc_id", "tag", "start", "stop", "x.a_doc", "x.a_tag", "x.a_start", "x.a_stop", "x.similarity")


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the words of ``spans`` (doc_id, tag, start, stop) taken out of ``text``.

    A document of which nothing but white space is left goes; documents without spans stay
    as they are, and so do rows that share an id with others but not the text. A document's
    spans are few (they don't overlap and have min_words each).
    """
    lists = spans.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    both = docs.join(lists, (F.col("doc_id") == F.col("__id")) & (F.crc32("text") == F.col("__tag")), "left").drop("__id", "__tag")

    def run(batches):
        for batch in (few for b in batches for few in V.slices(b)):
            at = batch.schema.get_field_index("text")
            spans = batch.column(batch.num_columns - 1)
            keep, columns = np.ones(batch.num_rows, bool), list(batch.columns)[:-1]
            touched = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(touched):
                text = batch.column(at).to_pylist()
                data, offsets = V.text_bytes(batch.column(at))
                for i in touched:
                    own = data[offsets[i] : offsets[i + 1]]
                    starts, _, _ = V.words(own, np.array([0, len(own)]))
                    starts, drop = np.append(starts, len(own)), np.zeros(len(own), bool)
                    for span in spans[int(i)].as_py():
                        # with the white space after the passage, so that what stood around it stays apart
                        a, b = (min(span[c], len(starts) - 1) for c in ("start", "stop"))
                        drop[starts[a] : starts[b]] = True
                    text[i] = own[~drop].tobytes().decode()
                    keep[i] = bool(text[i].strip())
                columns[at] = pa.array(text, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(keep))

    return both.mapInArrow(run, docs.schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated passage (removed) and one for each stretch that holds copies that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, s = Scratch(spark, "substring"), Settings(inside=True)
    found = scratch.keep(passages(spark, docs, s, scratch), "passages")
    gone = found.select("doc_id", F.col("start").cast("long").alias("start_word"), F.col("stop").cast("long").alias("stop_word"), F.col("a_doc").alias("source_doc_id"), F.col("a_start").cast("long").alias("source_start_word"), F.col("a_stop").cast("long").alias("source_stop_word"), "similarity", F.lit(True).alias("removed"))
    sources = found.select("a_doc", "a_tag", F.col("a_start").alias("start"), F.col("a_stop").alias("stop")).distinct()
    stays = united(sources, ("a_doc", "a_tag"), s).groupBy("a_doc", "a_tag", "run").agg(F.min("start").cast("long").alias("start_word"), F.max("stop").cast("long").alias("stop_word"))
    none = F.lit(None).cast("long")
    return gone.union(stays.select(F.col("a_doc").alias("doc_id"), "start_word", "stop_word", none, none, none, F.lit(1.0), F.lit(False)))
