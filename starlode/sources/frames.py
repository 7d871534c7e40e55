"""Sources of frames: a protocol for keys and paths, and a Spark data source over FITS files.

After ``register(spark)``, ``spark.read.format("frames").option("path", folder)`` gives the
headers of the files below a folder, with option ``hdu`` = "STAR-TAB" their star tables and
with "pixels" their planes; a partition for each file. ``df.write.format("frames")`` writes
rows (name, header, ny, nx, planes) as FITS cubes.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import fits


class FrameSource:
    """What frames there are: ``keys`` in a stable order, and the ``path`` of each. Instances go to tasks, so they must pickle."""

    def keys(self) -> list[str]:
        raise NotImplementedError

    def path(self, key: str) -> str:
        return key


@dataclass(frozen=True)
class FolderSource(FrameSource):
    """The files below folders whose name fits one of the patterns, each once, in the order of lower-cased paths."""

    roots: tuple[str, ...]
    patterns: tuple[str, ...] = ("*.fit", "*.fits")

    def keys(self) -> list[str]:
        from pyarrow import fs

        found = set()
        for root in self.roots:
            local = urlparse(root).scheme in ("", "file")
            system, inner = (fs.LocalFileSystem(), urlparse(root).path or root) if local else fs.FileSystem.from_uri(root)
            for info in system.get_file_info(fs.FileSelector(inner, recursive=True)):
                if info.is_file and any(fnmatch.fnmatch(info.base_name, p) for p in self.patterns):
                    found.add(info.path if local else f"{urlparse(root).scheme}://{info.path}")
        return sorted(found, key=lambda p: (p.lower(), p))


@dataclass(frozen=True)
class ListSource(FrameSource):
    """Given paths, by their keys."""

    paths: tuple[tuple[str, str], ...]

    def keys(self) -> list[str]:
        return [k for k, _ in self.paths]

    def path(self, key: str) -> str:
        return dict(self.paths)[key]


def frames_of(spark: SparkSession, source: FrameSource) -> DataFrame:
    """(key, path, place) of a source's frames; keys that stand twice raise ValueError."""
    keys = source.keys()
    if len(set(keys)) != len(keys):
        raise ValueError("a frame source gives a key twice")
    return spark.createDataFrame([(k, source.path(k), i) for i, k in enumerate(keys)], "key string, path string, place int")


PIXELS = "path string, band string, ny int, nx int, data binary"
TABLE = "path string, x double, y double, flux double"


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.source = FolderSource(tuple(options["path"].split(",")), tuple(options.get("pattern", "*.fit,*.fits").split(",")))
        self.hdu = options.get("hdu", "header")

    def partitions(self) -> list[InputPartition]:
        return [_File(self.source.path(k)) for k in self.source.keys()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        path = partition.path
        if self.hdu == "header":
            yield fits.header_row(path)
        elif self.hdu == "pixels":
            frame = fits.load_frame(path)
            for band, plane in zip(fits.BANDS, frame.data):
                yield path, band, *frame.shape, plane.astype("<f4").tobytes()
        else:
            table = fits.star_table(path)
            for row in [] if table is None else table:
                yield path, *(float(row[c]) for c in ("x", "y", "flux"))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")

    def write(self, rows) -> WriterCommitMessage:
        for row in rows:
            cube = np.frombuffer(row["planes"], "<f4").reshape(3, row["ny"], row["nx"])
            fits.write_bytes(f"{self.folder}/{row['name']}", fits.write_fits([("", cube)], fits.typed_header(row["header"])))
        return WriterCommitMessage()


class FrameFiles(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return {"header": fits.HEADER_SCHEMA, "pixels": PIXELS}.get(self.options.get("hdu", "header"), TABLE)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameFiles)
