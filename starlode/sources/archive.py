"""Small archives of example frames: cut-outs with shifted solutions, trimmed catalogues, a tar file and its digest."""

from __future__ import annotations

import hashlib
import io
import tarfile

import numpy as np
from pyspark.sql import DataFrame

from ..pixels.solver import Wcs
from ..plans.stages import in_any_frame
from .fits import Frame, write_bytes, write_fits


def centre_slice(shape: tuple[int, int], centre: tuple[float, float], size: int) -> tuple[slice, slice]:
    """(rows, columns) of a square about a place (x, y), moved inside the image; an image smaller than the square is taken whole."""
    out = []
    for n, at in zip(shape, centre[::-1]):
        start = min(max(int(round(at)) - size // 2, 0), max(n - size, 0))
        out.append(slice(start, min(start + size, n)))
    return out[0], out[1]


def brightest_pixel(plane: np.ndarray) -> tuple[int, int]:
    """(x, y) of the largest finite pixel."""
    y, x = np.unravel_index(np.nanargmax(np.where(np.isfinite(plane), plane, -np.inf)), plane.shape)
    return int(x), int(y)


def shift_wcs(wcs: Wcs, x0: int, y0: int) -> Wcs:
    """The solution of a cut-out that begins at (x0, y0)."""
    return Wcs((wcs.crpix[0] - x0, wcs.crpix[1] - y0), wcs.crval, wcs.cd)


def cut(frame: Frame, size: int, centre: tuple[float, float] | None = None, wcs: Wcs | None = None) -> tuple[bytes, Wcs | None]:
    """(FITS bytes, solution) of a square of a frame about a place, or its brightest green pixel. Cubes stay cubes, named planes named planes."""
    rows, columns = centre_slice(frame.shape, centre or brightest_pixel(frame.plane("G")), size)
    moved = shift_wcs(wcs, columns.start, rows.start) if wcs is not None else None
    header = frame.header | (moved.to_header() if moved is not None else {})
    data = np.ascontiguousarray(frame.data[:, rows, columns])
    planes = [("", data)] if frame.layout != "mef" else [("", None), *zip(("RED", "GREEN", "BLUE"), data)]
    return write_fits(planes, header), moved


def trim(catalogue: DataFrame, frames: DataFrame, margin: float = 20.0) -> DataFrame:
    """The catalogue rows that fall into one of the frames (path, ny, nx and a solution's columns)."""
    return in_any_frame(catalogue, frames, margin)


def pack(files: dict[str, bytes], path: str) -> str:
    """Writes a tar.gz of named contents and returns its SHA-256; equal contents make equal archives."""
    import gzip

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name in sorted(files):
            info = tarfile.TarInfo(name)
            info.size = len(files[name])
            tar.addfile(info, io.BytesIO(files[name]))
    data = gzip.compress(raw.getvalue(), mtime=0)
    write_bytes(path, data)
    return hashlib.sha256(data).hexdigest()
