"""Example datasets in a folder, and the drivers of three uses: a variable star, a supernova on its host, a transit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import headers
from .operators import ensemble, period
from .pixels.solver import Wcs, load_sidecar, sidecar_path, wcs_of
from .plans import extras, stages
from .plans.project import Project, Target
from .sources.ecsv import read_ecsv
from .sources.fits import Frame, load_frame, scan_file
from .sources.frames import FolderSource

#: Names of the examples, and what a frame's file name begins with: fixed values.
KINDS = {"stack": "stack_", "deep": "deep_", "saturated": "saturated_", "server": "server_", "sub": "sub_"}


@dataclass(frozen=True)
class Examples:
    """A folder with frames (by the beginnings in KINDS), a catalogue (catalogue.parquet or .ecsv) and solutions beside the frames."""

    folder: str

    def paths(self) -> dict[str, str]:
        """Each frame's path by its stem."""
        source = FolderSource((self.folder,))
        return {source.path(k).rpartition("/")[2].rpartition(".")[0]: source.path(k) for k in source.keys()}

    def available(self, kind: str | None = None) -> list[str]:
        start = KINDS[kind] if kind else ""
        return [s for s in self.paths() if s.startswith(start)]

    def is_there(self) -> bool:
        return bool(self.available())

    def path(self, stem: str) -> str:
        """KeyError names what there is."""
        found = self.paths()
        if stem not in found:
            raise KeyError(f"no example {stem!r}; there are {sorted(found)}")
        return found[stem]

    def frame(self, kind: str = "stack", n: int = 0) -> Frame:
        """The nth frame of a kind: a stack, a deep one, a saturated one, a server's file or a raw sub."""
        return load_frame(self.path(self.available(kind)[n]))

    def sub_paths(self) -> list[str]:
        return [self.path(s) for s in self.available("sub")]

    def wcs(self, stem: str) -> Wcs | None:
        """A frame's solution: its sidecar's, else its header's."""
        path = self.path(stem)
        return load_sidecar(sidecar_path(path)) or wcs_of(scan_file(path)[0].header)

    def catalogue(self, spark: SparkSession) -> DataFrame:
        stored = f"{self.folder.rstrip('/')}/catalogue"
        return spark.read.parquet(f"{stored}.parquet") if stages.exists(spark, f"{stored}.parquet") else read_ecsv(spark, f"{stored}.ecsv")

    def project(self, target: Target, work_dir: str, **settings) -> Project:
        """A project over the stacks; the catalogue is the folder's."""
        fetch = settings.pop("fetch", lambda spark, *_: self.catalogue(spark))
        return Project(target, self.folder, work_dir, fetch=fetch, catalogue_backend="fetch", **settings)


def only_object(frames: DataFrame, name: str) -> DataFrame:
    """The frames (with a header) of an object whose name holds ``name``, or that name none."""
    named: Column = F.coalesce(F.replace(F.upper(headers.text("header", "OBJECT")), F.lit(" "), F.lit("")), F.lit(""))
    return frames.where((named == "") | named.contains(name.upper().replace(" ", "")))


def variable_star(spark: SparkSession, project: Project, min_period: float = 0.02, max_period: float | None = 0.5, **comparisons) -> dict:
    """All three stages, then the target's light curve against its ensemble and its period: the curve, the search and the folded curve."""
    stages.solve_all(spark, project)
    stages.build_frame_table(spark, project)
    stars, measured = stages.build_measurements(spark, project)
    target = ensemble.target_row(stars).first()["source_id"]
    comps = ensemble.select_comparisons(stars, **comparisons)
    lc = ensemble.differential_lightcurve(measured, target, comps)
    found = period.search(lc, min_period=min_period, max_period=max_period)
    return {"lightcurve": lc, "comparisons": comps, "period": found, "folded": period.fold(lc, found["best_period"])}


def supernova(spark: SparkSession, project: Project, nucleus: tuple[float, float]) -> DataFrame:
    """(frame, mjd_mid, mag, mag_err, host, ...) of the target in each frame, less its host's light."""
    stages.solve_all(spark, project)
    frames = stages.build_frame_table(spark, project)
    zero = frames.where("zeropoint IS NOT NULL").select(F.col("path").alias("frame"), "zeropoint", "zeropoint_err", "mjd_mid")
    light = extras.host_azimuths(spark, project, project.frames(spark), nucleus, project.target.radec)
    return extras.corrected(light, zero.drop("mjd_mid")).join(zero.select("frame", "mjd_mid"), "frame").orderBy("mjd_mid")


def transit(lc: DataFrame, t0: float, period_days: float, duration_days: float, bins: int = 50) -> dict[str, DataFrame]:
    """A light curve folded about mid-transit, its depth (in minus out of transit, in magnitudes) and binned means."""
    folded = period.fold(lc, period_days, t0 - period_days / 2)
    inside = F.abs(F.col("phase") - 0.5) * period_days <= duration_days / 2
    depth = folded.agg((F.avg(F.when(inside, F.col("dmag"))) - F.avg(F.when(~inside, F.col("dmag")))).alias("depth"), F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))
    return {"folded": folded, "depth": depth, "bins": period.phase_bins(folded, bins)}
