"""Differential photometry: comparison stars, ensemble light curves and leave-one-out curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from ..functions.sky import separation_deg

STAR_COLUMNS = ("source_id", "ra", "dec", "phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag", "bp_rp", "v_jkc_mag", "b_jkc_mag", "r_jkc_mag", "phot_variable_flag")


def build_stars(catalogue: DataFrame, measurements: DataFrame, ra: float, dec: float, target_id: int | None = None) -> DataFrame:
    """The catalogue rows that were measured, their distance to the target and which one the target is.

    Without a target id it is the nearest row, the smaller id of two as near. An id that
    was not measured raises ValueError.
    """
    keep = [c for c in STAR_COLUMNS if c in catalogue.columns]
    measured = measured_rows(catalogue.select(*keep), measurements)
    stars = measured.withColumn("sep_target_arcmin", 60.0 * separation_deg(ra, dec, "ra", "dec"))
    if target_id is None:
        row = nearest(stars).select("source_id").first()
        target_id = row["source_id"] if row else None
    elif not stars.where(F.col("source_id") == target_id).limit(1).count():
        raise ValueError(f"target {target_id} was not measured")
    return stars.withColumn("is_target", F.col("source_id") == F.lit(target_id)).orderBy("sep_target_arcmin", "source_id")


def measured_ids(measurements: DataFrame) -> DataFrame:
    """The distinct ids of measurements."""
    return measurements.select("source_id").distinct()


def measured_rows(catalogue: DataFrame, measurements: DataFrame) -> DataFrame:
    """The catalogue rows whose id was measured."""
    return catalogue.join(measured_ids(measurements), "source_id", "left_semi")


def nearest(stars: DataFrame) -> DataFrame:
    """The row nearest to the target's position, the smaller id of two as near."""
    return stars.orderBy("sep_target_arcmin", "source_id").limit(1)


def target_row(stars: DataFrame, target_id: int | None = None) -> DataFrame:
    """The target's one row: the flagged one or that of an id."""
    wanted = F.col("is_target") if target_id is None else F.col("source_id") == target_id
    return stars.where(wanted).orderBy("source_id").limit(1)


def select_comparisons(
    stars: DataFrame,
    target_id: int | None = None,
    max_sep_arcmin: float | None = None,
    dmag: float | None = 1.0,
    mag_range: tuple[float, float] | None = None,
    colour_tol: float | None = 0.3,
    exclude_variable: bool = True,
    mag_col: str = "v_jkc_mag",
    colour_col: str = "bp_rp",
) -> DataFrame:
    """Stars that serve as comparisons. Cuts that are None, or whose column is missing, don't apply; unknown magnitudes never qualify."""
    has_colour = colour_tol is not None and colour_col in stars.columns
    target = target_row(stars, target_id).select(F.col("source_id").alias("__id"), F.col(mag_col).cast("double").alias("__mag"), *([F.col(colour_col).cast("double").alias("__colour")] if has_colour else []))
    mag = F.col(mag_col).cast("double")
    cuts: list[Column] = [F.col("source_id") != F.col("__id"), is_finite(mag)]
    if mag_range is not None:
        cuts.append(mag.between(min(mag_range), max(mag_range)))
    elif dmag is not None:
        cuts.append(F.abs(mag - F.col("__mag")) <= dmag)
    if has_colour:
        colour = F.col(colour_col).cast("double")
        cuts.append(is_finite(colour) & (F.abs(colour - F.col("__colour")) <= colour_tol))
    if max_sep_arcmin is not None and "sep_target_arcmin" in stars.columns:
        cuts.append(F.col("sep_target_arcmin") <= max_sep_arcmin)
    if exclude_variable and "phot_variable_flag" in stars.columns:
        cuts.append(F.coalesce(F.col("phot_variable_flag") != "VARIABLE", F.lit(True)))
    # The target is one row of bounded size.
    return stars.join(F.broadcast(target), reduce(lambda a, b: a & b, cuts)).select(*stars.columns)


def valid(measurements: DataFrame, band: str, inst_col: str = "m_inst", max_flag: int = 0) -> DataFrame:
    on_chip = F.col("on_chip") if "on_chip" in measurements.columns else F.lit(True)
    return measurements.where((F.col("band") == band) & on_chip & is_finite(inst_col) & (F.col("flag") <= max_flag))


def reference_mags(comps: DataFrame, cat_mag_col: str) -> DataFrame:
    """(source_id, cat): one magnitude for each comparison, the largest of those that share an id."""
    return comps.where(is_finite(F.col(cat_mag_col).cast("double"))).groupBy("source_id").agg(F.max(F.col(cat_mag_col).cast("double")).alias("cat"))


def first_rows(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def differential_lightcurve(
    measurements: DataFrame,
    target_id: int,
    comps: DataFrame,
    band: str = "G",
    time_col: str = "bjd_tdb",
    inst_col: str = "m_inst",
    cat_mag_col: str = "v_jkc_mag",
    min_comp: int = 3,
    max_flag: int = 0,
) -> DataFrame:
    """time, mag, mag_err, zp_ens, zp_scatter, n_comp, airmass, frame, dmag by time; a frame needs a valid target row and min_comp comparisons.

    Of several valid target rows of a frame the first by time and magnitude counts. The
    result keeps its columns when no frame qualifies.
    """
    good = valid(measurements, band, inst_col, max_flag)
    out = _curves(good, good.where(F.col("source_id") == target_id), comps, time_col, inst_col, cat_mag_col, min_comp)
    return out.drop("source_id").orderBy("time")


def lightcurves(measurements: DataFrame, targets: DataFrame, comps: DataFrame, band: str = "G", time_col: str = "bjd_tdb", inst_col: str = "m_inst", cat_mag_col: str = "v_jkc_mag", min_comp: int = 3, max_flag: int = 0) -> DataFrame:
    """differential_lightcurve of all ``targets`` (source_id) at once against the same comparisons, which hold none of them: its columns and source_id."""
    good = valid(measurements, band, inst_col, max_flag)
    return _curves(good, good.join(targets.select("source_id").distinct(), "source_id", "left_semi"), comps, time_col, inst_col, cat_mag_col, min_comp)


def _curves(good: DataFrame, rows: DataFrame, comps: DataFrame, time_col: str, inst_col: str, cat_mag_col: str, min_comp: int) -> DataFrame:
    joined = good.join(reference_mags(comps, cat_mag_col), "source_id").withColumn("zp", F.col("cat") - F.col(inst_col))
    zp = joined.groupBy("frame").agg(F.avg("zp").alias("zp_ens"), F.coalesce(F.stddev_samp("zp"), F.lit(0.0)).alias("zp_scatter"), F.count("*").alias("n_comp")).where(F.col("n_comp") >= min_comp)
    err = F.col("mag_err") if "mag_err" in good.columns else F.lit(0.0)
    air = F.col("airmass") if "airmass" in good.columns else F.lit(None)
    target = first_rows(rows, ("source_id", "frame"), time_col, inst_col)
    target = target.select("source_id", "frame", F.col(time_col).alias("time"), F.col(inst_col).alias("inst"), F.coalesce(err, F.lit(0.0)).cast("double").alias("err"), air.cast("double").alias("airmass"))
    lc = target.join(zp, "frame").withColumn("mag", F.col("inst") + F.col("zp_ens"))
    lc = lc.withColumn("mag_err", F.sqrt(F.pow("err", 2) + F.pow(F.col("zp_scatter") / F.sqrt("n_comp"), 2)))
    # A target's frames stand together for their median.
    lc = lc.withColumn("dmag", F.col("mag") - F.median("mag").over(W.partitionBy("source_id")))
    return lc.select("source_id", "time", "mag", "mag_err", "zp_ens", "zp_scatter", "n_comp", "airmass", "frame", "dmag")


def summary(lc: DataFrame, target_id: int, band: str, comps: DataFrame, cat_mag_col: str = "v_jkc_mag") -> DataFrame:
    """target_id, band, n_comp_pool and scatter of a light curve."""
    pool = reference_mags(comps, cat_mag_col).agg(F.count("*").alias("n_comp_pool"))
    return lc.agg(F.stddev_pop("mag").alias("scatter")).join(F.broadcast(pool)).select(F.lit(target_id).alias("target_id"), F.lit(band).alias("band"), "n_comp_pool", "scatter")


def comparison_curves(measurements: DataFrame, comps: DataFrame, band: str = "G", min_comp: int = 3, inst_col: str = "m_inst", cat_mag_col: str = "v_jkc_mag", time_col: str = "bjd_tdb", max_flag: int = 0) -> DataFrame:
    """Each comparison against all others of its frame: (source_id, frame, time, mag, zp_ens, zp_scatter, n_comp, dmag).

    The others' mean and scatter follow from the frame's sums less the star's own part,
    with zero points centred on the frame's mean first, so the work grows with the rows and
    not with their pairs.
    """
    good = valid(measurements, band, inst_col, max_flag).join(reference_mags(comps, cat_mag_col), "source_id").withColumn("zp", F.col("cat") - F.col(inst_col))
    frame = W.partitionBy("frame")
    rows = good.withColumn("n", F.count("*").over(frame)).withColumn("mean", F.avg("zp").over(frame)).withColumn("u", F.col("zp") - F.col("mean")).withColumn("uu", F.sum(F.col("u") * F.col("u")).over(frame))
    others = F.col("n") - 1
    rows = rows.where(others >= max(min_comp, 1))
    centre = -F.col("u") / others
    spread = F.when(others > 1, F.sqrt(F.greatest((F.col("uu") - F.col("u") * F.col("u") - others * centre * centre) / F.when(others > 1, others - 1), F.lit(0.0)))).otherwise(0.0)
    curve = rows.select("source_id", "frame", F.col(time_col).alias("time"), (F.col(inst_col) + F.col("mean") + centre).alias("mag"), (F.col("mean") + centre).alias("zp_ens"), spread.alias("zp_scatter"), others.alias("n_comp"))
    return curve.withColumn("dmag", F.col("mag") - F.median("mag").over(W.partitionBy("source_id")))


def scatter_ranking(curves: DataFrame, check: float = 0.05) -> DataFrame:
    """Scatter of each comparison's curve, the worst first, and whether it deserves a check."""
    out = curves.groupBy("source_id").agg(F.count("*").alias("n"), F.coalesce(F.stddev_pop("dmag"), F.lit(0.0)).alias("scatter"))
    return out.withColumn("check", F.col("scatter") > check).orderBy(F.desc("scatter"), "source_id")


#: Scatter below this (mag) is rounding, not scatter.
NO_SCATTER = 1e-9


def noise_floor(ranking: DataFrame) -> DataFrame:
    """The smallest positive scatter."""
    return ranking.agg(F.min(F.when(F.col("scatter") > NO_SCATTER, F.col("scatter"))).alias("floor"))


def with_frames(measurements: DataFrame, frames: DataFrame, *columns: str) -> DataFrame:
    """Measurements with columns of their frames' rows, the two tables joined on ``frame``."""
    return measurements.join(frames.select("frame", *columns), "frame")


def sources_per_frame(measurements: DataFrame) -> DataFrame:
    """(frame, n): how many measurements each frame has."""
    return measurements.groupBy("frame").agg(F.count("*").alias("n"))
