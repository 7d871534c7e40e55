"""Co-adding the subs of many fields at once: registration by task, sums by tile, one file for each stack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.growth import stack_report
from ..sources import fits
from ..sources.fits import load_frame, write_bytes, write_fits
from ..workspace import fresh_path

#: Rows of a frame that are summed together.
TILE = 256
SUMS = "field string, path string, tile int, ny int, nx int, total binary, weight binary, ok boolean, resid double, rotation double, exptime double, cover double, reason string"
NAMES = [f.split()[0] for f in SUMS.split(", ")]


def moved(keys: DataFrame, min_match: int = 6, max_resid_px: float = 1.0) -> DataFrame:
    """Rows SUMS of ``keys`` (field, path, place): the sums of a task's subs of a field, tile by tile, and a row (tile NULL) on each sub.

    A field's first sub by place gives the grid. Its subs are spread over tasks; a task holds
    one field's sum at a time, and a sub that can't be registered is a row with its reason.
    """
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
    first = keys.groupBy("field").agg(F.min_by("path", "place").alias("__first"))
    dealt = keys.join(first, "field").select("field", "path", "__first", "place")
    n = max(1, min(keys.count(), 4 * keys.sparkSession.sparkContext.defaultParallelism))

    def run(batches):
        from ..pixels import solver

        now, reference, shape, total, weight = None, None, None, None, None

        def rows(values):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*values), kinds)], NAMES)

        def tiles():
            ny, nx = shape
            for t in range(0, -(-ny // TILE)):
                cut = np.s_[t * TILE : (t + 1) * TILE]
                yield rows([(now[0], None, t, ny, nx, total[:, cut].astype("<f8").tobytes(), weight[cut].astype("<f8").tobytes(), None, None, None, None, None, None)])

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["field"], row["__first"])
                if key != now:
                    if total is not None:
                        yield from tiles()
                    now, total, weight = key, None, None
                    grid = load_frame(key[1])
                    reference, shape = solver.stars_of(grid), grid.shape
                said = [row["field"], row["path"], None, *shape, None, None]
                try:
                    frame = load_frame(row["path"])
                    if row["path"] == key[1]:
                        data, on, resid, turn = frame.data.astype(np.float64), np.ones(shape), None, 0.0
                    else:
                        move, resid = solver.register(solver.stars_of(frame), reference, min_match, max_resid_px)
                        planes = [solver.warp(p, move, shape) for p in frame.data]
                        data, on, turn = np.stack([p[0] for p in planes]).astype(np.float64), planes[0][1], float(np.degrees(np.arctan2(move[1, 0], move[0, 0])))
                except Exception as e:
                    yield rows([(*said, False, None, None, None, None, f"{row['path']}: {e}")])
                    continue
                total, weight = (data, on.astype(np.float64)) if total is None else (total + data, weight + on)
                yield rows([(*said, True, resid, turn, solver.exposure_of(frame.header), float(on.mean()), None)])
        if total is not None:
            yield from tiles()

    return dealt.repartition(n, "field", F.pmod("place", F.lit(n))).sortWithinPartitions("field", "place").select("field", "path", "__first").mapInArrow(run, SUMS)


def reports(sums: DataFrame) -> DataFrame:
    """A row for each field: growth.stack_report's columns and cover_frac, the mean part of the grid that a sub covers."""
    subs = sums.where("tile IS NULL")
    cover = subs.where("ok").groupBy("field").agg(F.avg("cover").alias("cover_frac"))
    return stack_report(subs, ("field",)).join(cover, "field", "left")


def mean_tiles(sums: DataFrame) -> DataFrame:
    """(field, tile, ny, nx, mean, weight): each tile's footprint-weighted mean of all tasks' sums, zero where no sub reaches."""
    names = ["field", "tile", "ny", "nx", "mean", "weight"]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight, ny, nx = None, None, 0, 0
        for batch in batches:
            for t, w, y, x in zip(*(batch.column(c).to_pylist() for c in ("total", "weight", "ny", "nx"))):
                t, w, ny, nx = np.frombuffer(t, "<f8"), np.frombuffer(w, "<f8"), y, x
                total, weight = (t.copy(), w.copy()) if total is None else (total + t, weight + w)
        mean = np.where(weight > 0.5, total.reshape(3, -1) / np.maximum(weight, 1), 0).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([ny], pa.int32()), pa.array([nx], pa.int32()), pa.array([mean.tobytes()]), pa.array([weight.astype("<f4").tobytes()])], names)

    rows = sums.where("tile IS NOT NULL").select("field", "tile", "ny", "nx", "total", "weight")
    return rows.groupBy("field", "tile").applyInArrow(run, "field string, tile int, ny int, nx int, mean binary, weight binary")


def stack(spark: SparkSession, keys: DataFrame, folder: str, weight_plane: bool = False, min_match: int = 6, max_resid_px: float = 1.0) -> DataFrame:
    """Stacks the subs (field, path, place) of each field and writes ``folder``/field.fits; a row for each field with its report and file.

    The file is a cube in the native dialect, without a solution, with a WEIGHT plane if
    asked for. A field without a sub that could be read has no file.
    """
    aside = fresh_path(spark, "stack")
    moved(keys, min_match, max_resid_px).write.parquet(aside)
    sums = spark.read.parquet(aside)
    report = reports(sums)
    first = keys.groupBy("field").agg(F.min_by("path", "place").alias("first"))
    whole = mean_tiles(sums).join(report.join(first, "field").select("field", "first", "n_ok", "total_exptime"), "field")
    folder = folder.rstrip("/")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..pixels.solver import stack_header

        parts, head = [], None
        for batch in batches:
            for row in batch.to_pylist():
                parts.append((row["tile"], np.frombuffer(row["mean"], "<f4").reshape(3, -1, row["nx"]), np.frombuffer(row["weight"], "<f4").reshape(-1, row["nx"])))
                head = row
        parts.sort(key=lambda p: p[0])
        cube, weight = np.concatenate([p[1] for p in parts], axis=1), np.concatenate([p[2] for p in parts])
        header = stack_header(fits.scan_file(head["first"])[0].header, head["n_ok"], head["total_exptime"])
        name = f"{folder}/{head['field']}.fits"
        write_bytes(name, write_fits([("", cube), *([("WEIGHT", weight)] if weight_plane else [])], header))
        yield pa.RecordBatch.from_arrays([pa.array([head["field"]]), pa.array([name])], ["field", "file"])

    # One frame to a task: its tiles, as large as a sub.
    files = whole.groupBy("field").applyInArrow(run, "field string, file string")
    files.write.parquet(f"{aside}_files")
    return report.join(spark.read.parquet(f"{aside}_files"), "field", "left")
