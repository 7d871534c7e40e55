"""Bloom tables of ids: they save reading and decide nothing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import textvec as V

#: Bits of the largest table (32 MB), the bound of what is broadcast. A table too small for its ids only lets more rows pass.
MOST_BITS = 28
CHUNK = 1 << 16


@dataclass(frozen=True)
class Table:
    """2 ** bits bits, three of them set for each id."""

    bits: int
    data: np.ndarray

    def holds(self, ids: np.ndarray) -> np.ndarray:
        at = places(ids, self.bits)
        return np.all((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1, axis=0)

    def shared(self, spark: SparkSession):
        return spark.sparkContext.broadcast(self)


def places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = V.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(V.BASE))
    return np.stack([(V.mix(h + np.uint64(j)) >> np.uint64(64 - bits)).astype(np.int64) for j in range(3)])


def table_of(ids: DataFrame) -> Table:
    """The table of a column of longs, at 12 bits an id or more up to MOST_BITS. Tasks build it, the driver unites chunks."""
    bits = min(max((12 * ids.count()).bit_length(), 19), MOST_BITS)
    size = 1 << (bits - 3)

    def run(batches):
        table = np.zeros(size, np.uint8)
        for batch in batches:
            at = places(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for chunk in range(0, size, CHUNK):
            part = table[chunk : chunk + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk // CHUNK], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)])], ["chunk", "data"])

    def unite(batches):
        table: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = np.frombuffer(zstandard.decompress(data.as_py()), np.uint8)
                table[chunk] = table[chunk] | row if chunk in table else row
        for chunk, row in table.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zstandard.compress(row.tobytes(), 1)])], ["chunk", "data"])

    rows = ids.mapInArrow(run, "chunk int, data binary").repartition(max(1, size // CHUNK), "chunk").mapInArrow(unite, "chunk int, data binary").collect()
    out = np.zeros(size, np.uint8)
    for row in rows:
        got = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
        out[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(got)] = got
    return Table(bits, out)
