"""What a reduction is configured by: the target, the frames, the folders and the numeric choices."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources import catalogue as cat
from ..sources.fits import list_frames
from ..sources.frames import FrameSource, frames_of


@dataclass(frozen=True)
class Target:
    name: str
    ra: float
    dec: float
    source_id: int | None = None

    @property
    def radec(self) -> tuple[float, float]:
        return self.ra, self.dec


@dataclass
class Project:
    """provenance and mask are functions of a Frame (and its Wcs): extra columns of a frame's row, pixels to leave out.
    Provenance columns have the types of their values and replace columns of the same name.

    frame_source gives the frames instead of frame_roots. attempts and wait_s: how often a
    frame whose work fails for want of a file or a service is tried, and how many seconds
    longer each time the wait is.

    catalogue_backend: "local" (a dataset at catalogue_dataset), "fetch" (a function of
    position and radius) or "auto", which takes the dataset if it covers the field.
    """

    target: Target
    frame_roots: str | list[str]
    work_dir: str
    patterns: tuple[str, ...] = ("*.fit", "*.fits")
    curate: Callable | None = None
    solver: str = "local"
    enclosed_characterise: float = 0.90
    enclosed_lightcurve: float = 0.95
    thresh: float = 2.0
    half_size_deg: float = 1.5
    n_tiles: int = 1
    gmag_limit: float = 17.0
    match_tol_arcsec: float = 2.0
    catalogue_backend: str = "auto"
    catalogue_dataset: str | None = None
    fetch: Callable | None = None
    provenance: Callable | None = None
    mask: Callable | None = None
    isolation: float | None = None
    frame_source: FrameSource | None = None
    attempts: int = 1
    wait_s: float = 5.0

    def path(self, name: str) -> str:
        return f"{self.work_dir.rstrip('/')}/{name}"

    @property
    def slug(self) -> str:
        return re.sub(r"[^\w-]", "_", self.target.name.lower()).strip("_") or "field"

    @property
    def catalogue_path(self) -> str:
        return self.path(f"catalogue_{self.slug}")

    @property
    def frames_path(self) -> str:
        return self.path("frames")

    @property
    def stars_path(self) -> str:
        return self.path("stars")

    @property
    def measurements_path(self) -> str:
        return self.path("measurements")

    @property
    def wcs_path(self) -> str:
        return self.path("wcs")

    @property
    def status_path(self) -> str:
        return self.path("frame_status")

    @property
    def diagnostics_dir(self) -> str:
        return self.path("diagnostics")

    @property
    def catalogue_radius_deg(self) -> float:
        return self.half_size_deg * 2**0.5 + 0.1

    #: Tables of stage 2 beside the frames: curves of growth, widths, background tiles, sources and fit points.
    DETAILS = ("cog", "bands", "tiles", "sources", "points")

    def frames(self, spark: SparkSession) -> DataFrame:
        if self.frame_source is not None:
            return frames_of(spark, self.frame_source).orderBy("place")
        return list_frames(spark, self.frame_roots, self.patterns, self.curate)

    def catalogue_backend_used(self, spark: SparkSession) -> str:
        if self.catalogue_backend != "auto":
            return self.catalogue_backend
        local = self.catalogue_dataset and cat.covers(spark, self.catalogue_dataset, *self.target.radec, self.catalogue_radius_deg)
        return "local" if local else "fetch"

    def catalogue(self, spark: SparkSession, overwrite: bool = False) -> DataFrame:
        """The field's catalogue, from its cache or by the backend."""
        system, target = cat._filesystem(spark, self.catalogue_path)
        if overwrite or not system.exists(target):
            if self.catalogue_backend_used(spark) == "local":
                rows = cat.cone(spark, self.catalogue_dataset, *self.target.radec, self.catalogue_radius_deg, gmag_limit=self.gmag_limit)
            elif self.fetch is not None:
                rows = cat.mosaic(lambda ra, dec, r: self.fetch(spark, ra, dec, r), *self.target.radec, self.half_size_deg, self.n_tiles)
            else:
                raise ValueError("no catalogue dataset covers the field and there is no fetch function")
            rows.write.mode("overwrite").parquet(self.catalogue_path)
        return spark.read.parquet(self.catalogue_path)
