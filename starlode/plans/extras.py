"""Kron photometry and host light of many frames, as DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import MAG_PER_SNR, instrumental_mag
from ..operators.growth import host_flux
from ..sources.fits import load_frame
from .project import Project
from .stages import per_frame, solved, wcs_from

KRON = "band string, x double, y double, flux double, fluxerr double, flag int, kron_radius double"
KRON_NAMES = [c.split()[0] for c in KRON.split(", ")]


def kron_sources(keys: DataFrame, thresh: float = 2.0) -> DataFrame:
    """(path, status, message, band, x, y, flux, fluxerr, flag, kron_radius): elliptical photometry of each frame's detections."""

    def work(row):
        from ..pixels.photometry import extract_kron

        got = extract_kron(load_frame(row["path"]), thresh)
        return [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(*(got[c] for c in KRON_NAMES))]

    return per_frame(keys.select("path"), work, KRON, KRON_NAMES)


AZIMUTHS = "azimuth double, flux double, clean boolean, target_flux double, aperture double, snr double"
AZIMUTH_NAMES = [c.split()[0] for c in AZIMUTHS.split(", ")]


def host_azimuths(spark: SparkSession, project: Project, keys: DataFrame, nucleus: tuple[float, float], target: tuple[float, float], band: str = "G", step_deg: float = 15.0) -> DataFrame:
    """(path, status, message, azimuth, flux, clean, ...): apertures at the target's distance from the host's nucleus, in each frame.

    ``clean`` is false where an aperture lies off the image, on another star or within two
    radii of the target. Positions are (ra, dec); frames without a solution have status no_wcs.
    """
    thresh, enclosed = project.thresh, project.enclosed_lightcurve

    def work(row):
        from ..pixels import photometry as ph

        wcs = wcs_from(row)
        frame = load_frame(row["path"])
        (x0, x1), (y0, y1) = (np.asarray(v, float) for v in wcs.to_pixel([nucleus[0], target[0]], [nucleus[1], target[1]]))
        sub, _, rms, objs = ph.detect(frame.plane(band), thresh)
        fwhm = ph.measure_fwhm(sub, objs, rms)
        r = ph.size_aperture(ph.growth_curve(sub, objs, rms), fwhm, enclosed=enclosed)
        mask = ph.star_mask(sub, rms, (x0, y0))
        dist, start = np.hypot(x1 - x0, y1 - y0), np.arctan2(y1 - y0, x1 - x0)
        angle = start + np.radians(np.arange(0, 360, step_deg))
        x, y = x0 + dist * np.cos(angle), y0 + dist * np.sin(angle)
        flux, _, flag = ph.sum_circle(sub, x, y, r, rms, mask)
        ny, nx = frame.shape
        clean = (flag & ph.FLAG_MASKED == 0) & (np.hypot(x - x1, y - y1) >= 2 * r) & (x >= r) & (x < nx - r) & (y >= r) & (y < ny - r)
        (own,), (err,), _ = ph.sum_circle(sub, [x1], [y1], r, rms)
        return [(float(np.degrees(a)) % 360, float(f), bool(c), float(own), float(r), float(own / err) if err > 0 else None) for a, f, c in zip(angle, flux, clean)]

    return per_frame(solved(spark, project, keys), work, AZIMUTHS, AZIMUTH_NAMES)


def corrected(azimuths: DataFrame, zeropoints: DataFrame) -> DataFrame:
    """(frame, flux, host, host_std, n, mag, mag_err): the target's magnitude less its host's light.

    The error adds in quadrature those of the photons, the zero point and the host's light;
    without a scatter of the host's light that part is none. ``zeropoints`` is (frame,
    zeropoint, zeropoint_err).
    """
    rows = azimuths.where("status = 'ok'").withColumnRenamed("path", "frame")
    host = host_flux(rows)
    own = rows.groupBy("frame").agg(F.first("target_flux").alias("target_flux"), F.first("snr").alias("snr"))
    out = own.join(host, "frame").join(zeropoints, "frame").withColumn("flux", F.col("target_flux") - F.col("host"))
    photons, light = MAG_PER_SNR / F.col("snr"), MAG_PER_SNR * F.coalesce("host_std", F.lit(0.0)) / F.col("flux")
    err = F.sqrt(photons * photons + F.coalesce("zeropoint_err", F.lit(0.0)) * F.coalesce("zeropoint_err", F.lit(0.0)) + light * light)
    return out.select("frame", "flux", "host", "host_std", "n", (instrumental_mag("flux") + F.col("zeropoint")).alias("mag"), F.when(F.col("flux") > 0, err).alias("mag_err"))


CUTOUT = "ny int, nx int, stamp binary, nucleus_x double, nucleus_y double, target_x double, target_y double, x0 int, y0 int"
CUTOUT_NAMES = [c.split()[0] for c in CUTOUT.split(", ")]


def host_cutouts(spark: SparkSession, project: Project, keys: DataFrame, nucleus: tuple[float, float], target: tuple[float, float], band: str = "G", half: int = 70) -> DataFrame:
    """A stamp (float32, row by row) about the host in each frame, with the places of nucleus and target in it."""
    thresh = project.thresh

    def work(row):
        from ..pixels import photometry as ph

        wcs = wcs_from(row)
        sub = ph.detect(load_frame(row["path"]).plane(band), thresh)[0]
        places = [tuple(float(v) for v in wcs.to_pixel(*p)) for p in (nucleus, target)]
        got = ph.cutout(sub, *places, half)
        return [(*got["stamp"].shape, got["stamp"].astype("<f4").tobytes(), *got["nucleus"], *got["target"], *got["origin"])]

    return per_frame(solved(spark, project, keys), work, CUTOUT, CUTOUT_NAMES)
