"""The reports: the data of every figure of a frame, of all frames, of measurements and of a light curve.

Each function returns DataFrames by name; ``diagnostics.write_report`` writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import RMS_PHOTOMETRIC
from ..operators import depth, diagnostics, ensemble, period
from .project import Project
from .stages import sorted_frames, table


def _tables(spark: SparkSession, project: Project) -> dict[str, DataFrame]:
    out = {name: table(spark, project.path(name)) for name in (*Project.DETAILS, "frames")}
    if out["frames"] is None:
        raise ValueError("no frame has been characterised")
    return out


def frame_report(spark: SparkSession, project: Project, paths: list[str] | None = None) -> dict[str, DataFrame]:
    """The thirteen products of frames (of all, or of some paths), each with a column frame."""
    t = _tables(spark, project)
    if paths is not None:
        t = {n: df.where(F.col("path" if n == "frames" else "frame").isin(paths)) for n, df in t.items()}
    out = {
        "curve_of_growth": diagnostics.curve_of_growth(t["cog"], t["bands"]),
        "fwhm_bands": diagnostics.fwhm_bands(t["bands"]),
        "reference_vs_instrumental": diagnostics.reference_vs_instrumental(t["points"]),
        "zeropoint_vs_colour": diagnostics.zeropoint_vs_colour(t["points"]),
        "residual_map": diagnostics.residual_map(t["points"]),
        "mag_snr": diagnostics.mag_snr(t["sources"]),
        "background_panels": diagnostics.background_panels(t["tiles"]),
        "detection_overlay": diagnostics.detection_overlay(t["sources"], 0, 0),
        "match_separation": diagnostics.match_separation(t["sources"], project.match_tol_arcsec),
        "instrumental_colour": diagnostics.instrumental_colour(t["sources"]),
    }
    for against in ("v", "snr", "radius"):
        points, line = diagnostics.residual_vs(t["points"], against)
        out[f"residual_vs_{against}"] = points.withColumn("part", F.lit("point")).unionByName(line.withColumn("part", F.lit("median")), allowMissingColumns=True)
    return out


def sample_frame_reports(spark: SparkSession, project: Project, n: int = 3) -> dict[str, dict[str, DataFrame]]:
    """frame_report for the frames with the smallest, the middle and the largest scatter of their calibration (n of them, evenly ranked)."""
    ranked = [r["path"] for r in _tables(spark, project)["frames"].where("rms IS NOT NULL").orderBy("rms", "path").select("path").collect()]
    if not ranked:
        return {}
    picks = sorted({round(i * (len(ranked) - 1) / max(n - 1, 1)) for i in range(n)})
    return {ranked[i]: frame_report(spark, project, [ranked[i]]) for i in picks}


def frames_report(spark: SparkSession, project: Project) -> dict[str, DataFrame]:
    """The products of the frame table: series of conditions by unit, distributions, depth against exposure and its drivers."""
    frames = sorted_frames(_tables(spark, project)["frames"])
    out = {f"series_{c}": diagnostics.series_by_unit(frames, c) for c in ("zeropoint", "fwhm_G", "sky_sb", "airmass", "n_matched")}
    out["rms_histogram"], out["rms_below"] = diagnostics.metric_histogram(frames, "rms", RMS_PHOTOMETRIC)
    out["rms_percentiles"] = depth.rms_percentiles(frames)
    out["depth_by_model"] = depth.detection_limit(frames)
    out["depth_grid"] = depth.limit_vs_exptime(frames)
    out["depth_vs_exptime"] = diagnostics.depth_vs_exptime(frames)
    for driver in ("sky_sb", "fwhm_G"):
        out[f"depth_vs_{driver}"], out[f"depth_vs_{driver}_trend"] = diagnostics.depth_vs_driver(frames, driver)
    out["depth_model"] = depth.fit_depth_model(frames, keys=("unit",))
    return out


def measurements_report(spark: SparkSession, project: Project) -> dict[str, DataFrame]:
    """The products of the measurements: how many a frame has, and each frame's calibration beside them."""
    measured, frames = table(spark, project.measurements_path), _tables(spark, project)["frames"]
    if measured is None:
        raise ValueError("nothing has been measured")
    counts = ensemble.sources_per_frame(measured)
    quality = frames.select(F.col("path").alias("frame"), "unit", "mjd_mid", "zeropoint", "rms", "fwhm_G")
    return {"sources_per_frame": counts, "frame_quality": ensemble.with_frames(counts, quality, "unit", "mjd_mid", "zeropoint", "rms", "fwhm_G"), "mag_error": measured.select("frame", "band", "m_inst", "mag_err")}


def lightcurve_report(spark: SparkSession, project: Project, band: str = "G", min_period: float = 0.01, wcs: dict | None = None, **comparisons) -> dict[str, DataFrame]:
    """The products of the target's light curve; ``comparisons`` go to select_comparisons. With ``wcs`` also the finder chart.

    A curve of fewer than five points has no periodogram and no folded curve.
    """
    stars, measured = table(spark, project.stars_path), table(spark, project.measurements_path)
    if stars is None or measured is None:
        raise ValueError("nothing has been measured")
    target = ensemble.target_row(stars).first()["source_id"]
    comps = ensemble.select_comparisons(stars, **comparisons)
    lc = ensemble.differential_lightcurve(measured, target, comps, band)
    curves = ensemble.comparison_curves(measured, comps, band)
    out = {
        "lightcurve": diagnostics.lightcurve(lc),
        "raw_flux": diagnostics.raw_flux(measured, target, band),
        "ensemble_zeropoint": diagnostics.ensemble_zeropoint(lc),
        "comparison_grid": diagnostics.comparison_grid(curves),
        "scatter_vs_magnitude": diagnostics.scatter_vs_magnitude(curves, comps),
        "summary": ensemble.summary(lc, target, band, comps),
    }
    if wcs is not None:
        out["finder_chart"] = diagnostics.finder_chart(stars, comps, {k: F.lit(float(v)) for k, v in wcs.items()})
    try:
        pg = period.periodogram(lc, min_period)
    except ValueError:
        return out
    out["periodogram"] = pg
    top = period.best_period(pg).first()
    if top is not None:
        out["phase_folded"] = period.fold(lc, top["period"])
        out["phase_bins"] = period.phase_bins(out["phase_folded"])
    return out
