"""The data behind each diagnostic figure, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import EXPTIME_REF, instrumental_mag, is_finite
from . import depth, ensemble, period


def trend(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, slope, intercept, n) of a straight line through the finite points, for over five of them."""
    rows = df.where(is_finite(x) & is_finite(y)).groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))
    return rows.where("n > 5")


def curve_of_growth(cog: DataFrame, bands: DataFrame) -> DataFrame:
    """The curves with the aperture that each band uses."""
    return cog.join(bands.select("frame", "band", "aperture"), ["frame", "band"], "left")


def fwhm_bands(bands: DataFrame) -> DataFrame:
    """One row a frame: widths by band and their ratios to green."""
    wide = bands.groupBy("frame").pivot("band", ["R", "G", "B"]).agg(F.first("fwhm"))
    green = F.when(F.col("G") > 0, F.col("G"))
    return wide.select("frame", F.col("R").alias("fwhm_R"), F.col("G").alias("fwhm_G"), F.col("B").alias("fwhm_B"), (F.col("R") / green).alias("R_over_G"), (F.col("B") / green).alias("B_over_G"))


def reference_vs_instrumental(points: DataFrame) -> DataFrame:
    return points.select("frame", "m_inst", "v", "keep", (F.col("m_inst") + F.col("zp")).alias("line"))


def zeropoint_vs_colour(points: DataFrame) -> DataFrame:
    return points.select("frame", "colour", (F.col("r") - F.col("zp")).alias("residual"), (F.col("k") * F.col("x")).alias("fit"), "keep")


def residual_vs(points: DataFrame, against: str = "v") -> tuple[DataFrame, DataFrame]:
    """(points, running median) of residuals against v, snr or the distance from the frame's median position."""
    if against == "radius":
        w = W.partitionBy("frame")
        points = points.withColumn("radius", F.sqrt(F.pow(F.col("x_pix") - F.median("x_pix").over(w), 2) + F.pow(F.col("y_pix") - F.median("y_pix").over(w), 2)))
    rows = points.select("frame", F.col(against).alias("x"), F.col("resid").alias("y"), "keep")
    return rows, period.running_median(rows.where("keep"), "x", "y", ("frame",))


def residual_map(points: DataFrame) -> DataFrame:
    """Kept residuals by position, and the span that covers 95 % of them."""
    span = F.percentile(F.abs("resid"), 0.95).over(W.partitionBy("frame"))
    return points.where("keep").withColumn("span", span).select("frame", "x_pix", "y_pix", "resid", "span")


def mag_snr(sources: DataFrame) -> DataFrame:
    return sources.select("frame", "band", instrumental_mag("flux").alias("m_inst"), "snr").where(is_finite("m_inst"))


def background_panels(tiles: DataFrame) -> DataFrame:
    """(frame, panel, p1, p50, p99) of background, model and residual tiles (frame, background, model)."""
    long = tiles.select("frame", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("background", "model", "residual"))), F.array("background", "model", F.col("background") - F.col("model")))).alias("panel", "value"))
    p = F.percentile("value", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    return long.groupBy("frame", "panel").agg(p.alias("p")).select("frame", "panel", F.col("p")[0].alias("p1"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p99"))


def detection_overlay(sources: DataFrame, nx: int, ny: int, half: int | None = None, matched_only: bool = False) -> DataFrame:
    out = sources.withColumn("matched", F.col("source_id").isNotNull())
    if half is not None:
        out = out.where((F.abs(F.col("x") - nx / 2) <= half) & (F.abs(F.col("y") - ny / 2) <= half))
    return (out.where("matched") if matched_only else out).select("frame", "band", "x", "y", "a", "b", "theta", "matched")


def match_separation(sources: DataFrame, tol_arcsec: float = 2.0, bins: int = 40) -> DataFrame:
    return period.histogram(sources.where(F.col("sep_arcsec") < 3 * tol_arcsec), "sep_arcsec", bins, log=True)


def instrumental_colour(sources: DataFrame) -> DataFrame:
    """(frame, source_id, inst, cat): instrumental and catalogue B - R of sources seen in both bands, joined by id."""
    side = lambda band: sources.where(F.col("band") == band).groupBy("frame", "source_id").agg(F.max_by(instrumental_mag("flux"), "snr").alias(f"m_{band}"), F.first("b_jkc_mag").alias(f"b_{band}"), F.first("r_jkc_mag").alias(f"r_{band}"))
    both = side("R").join(side("B"), ["frame", "source_id"])
    return both.select("frame", "source_id", (F.col("m_B") - F.col("m_R")).alias("inst"), (F.col("b_R") - F.col("r_R")).alias("cat")).where(is_finite("inst") & is_finite("cat"))


def series_by_unit(frames: DataFrame, column: str, time: str = "mjd_mid") -> DataFrame:
    """(unit, time, value, since) of a frame metric, by unit and time: zero points, conditions, coverage."""
    start = F.min(time).over(W.partitionBy("unit"))
    return frames.where(is_finite(column)).select("unit", F.col(time).alias("time"), F.col(column).alias("value"), (F.col(time) - start).alias("since")).orderBy("unit", "time")


def metric_histogram(frames: DataFrame, column: str = "rms", threshold: float | None = None, log: bool = False) -> tuple[DataFrame, DataFrame]:
    below = frames.where(is_finite(column)).agg(F.count("*").alias("n"), F.count_if(F.col(column) < threshold).alias("below") if threshold is not None else F.lit(None).cast("long").alias("below"))
    return period.histogram(frames, column, 40, log), below


def depth_vs_exptime(frames: DataFrame, group: str = "model") -> DataFrame:
    """Each group's points and the square-root-of-time line through its medians."""
    rows = depth.photometric(frames).where(F.col("total_exptime") > 0)
    w = W.partitionBy(group)
    line = F.median("v_lim_5sigma").over(w) + 1.25 * F.log10(F.col("total_exptime") / F.median("total_exptime").over(w))
    return rows.select(group, "total_exptime", "v_lim_5sigma", line.alias("line"))


def depth_vs_driver(frames: DataFrame, driver: str = "sky_sb", group: str = "unit") -> tuple[DataFrame, DataFrame]:
    """Depth at the reference exposure against a condition, and its trend by group."""
    rows = depth.photometric(frames).where(F.col("total_exptime") > 0)
    rows = rows.select(group, F.col(driver).alias("x"), (F.col("v_lim_5sigma") + 1.25 * F.log10(EXPTIME_REF / F.col("total_exptime"))).alias("y"))
    return rows, trend(rows, "x", "y", (group,))


def finder_chart(stars: DataFrame, comps: DataFrame, wcs: dict) -> DataFrame:
    from ..functions.sky import world_to_pixel

    x, y = world_to_pixel("ra", "dec", wcs)
    role = F.when(F.col("is_target"), "target").when(F.col("__c").isNotNull(), "comparison").otherwise("star")
    marked = stars.join(comps.select("source_id", F.lit(1).alias("__c")).distinct(), "source_id", "left")
    return marked.select("source_id", x.alias("x"), y.alias("y"), role.alias("role"))


def lightcurve(lc: DataFrame) -> DataFrame:
    """The series with its scatter and median error."""
    w = W.partitionBy(F.lit(1))
    return lc.select("time", "dmag", "mag_err", F.stddev_pop("dmag").over(w).alias("scatter"), F.median("mag_err").over(w).alias("median_err"))


def raw_flux(measurements: DataFrame, source_id: int, band: str = "G") -> DataFrame:
    return measurements.where((F.col("source_id") == source_id) & (F.col("band") == band)).select("bjd_tdb", "flux", "fluxerr").orderBy("bjd_tdb")


def ensemble_zeropoint(lc: DataFrame) -> DataFrame:
    return lc.select("time", "zp_ens", (F.col("zp_ens") - F.col("zp_scatter")).alias("low"), (F.col("zp_ens") + F.col("zp_scatter")).alias("high"))


def comparison_grid(curves: DataFrame, max_panels: int = 16) -> DataFrame:
    """The curves of the worst comparisons, with their rank, scatter and check flag."""
    worst = ensemble.scatter_ranking(curves).limit(max_panels).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("scatter"), "source_id")))
    return curves.join(F.broadcast(worst.drop("n")), "source_id").select("rank", "source_id", "time", "dmag", "scatter", "check").orderBy("rank", "time")


def scatter_vs_magnitude(curves: DataFrame, comps: DataFrame, mag_col: str = "v_jkc_mag") -> DataFrame:
    """(source_id, mag, scatter_mmag, floor_mmag)."""
    ranked = ensemble.scatter_ranking(curves)
    mags = ensemble.reference_mags(comps, mag_col)
    floor = F.broadcast(ensemble.noise_floor(ranked))  # one row
    return ranked.join(floor, how="cross").withColumn("floor_mmag", 1000 * F.col("floor")).join(mags, "source_id").select("source_id", F.col("cat").alias("mag"), (1000 * F.col("scatter")).alias("scatter_mmag"), "floor_mmag")


def write_report(products: dict[str, DataFrame], outdir: str) -> dict[str, str]:
    """Writes each product's rows as Parquet under a name of its own; a product that fails is skipped and reported."""
    written = {}
    for name, df in sorted(products.items()):
        try:
            df.write.mode("overwrite").parquet(f"{outdir}/{name}")
            written[name] = f"{outdir}/{name}"
        except Exception as e:
            written[name] = f"failed: {type(e).__name__}"
    return written
