"""Curves of growth, widths and point-source cuts from per-star rows, and stack and host summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import is_finite


def median_growth(rows: DataFrame, keys: tuple[str, ...] = ("frame", "band")) -> DataFrame:
    """(keys, radius, flux_frac, flux_frac_std, n_stars) of rows (keys, star, radius, flux): each star's flux over that of its largest radius."""
    star = W.partitionBy(*keys, "star")
    last = F.max_by("flux", "radius").over(star)
    frac = rows.withColumn("last", last).where("last > 0").withColumn("frac", F.col("flux") / F.col("last"))
    return frac.groupBy(*keys, "radius").agg(F.median("frac").alias("flux_frac"), F.stddev_pop("frac").alias("flux_frac_std"), F.count("*").alias("n_stars"))


def interpolate(cog: DataFrame, at: float, x: str, y: str, keys: tuple[str, ...] = ("frame", "band"), order: str = "radius") -> DataFrame:
    """(keys, value): y where x first reaches ``at`` along ``order``, linear between two rows, clamped at the ends."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = cog.where(is_finite(x)).select(*keys, F.col(order).alias("__o"), F.col(x).alias("x1"), F.col(y).alias("y1"), F.lag(x).over(w).alias("x0"), F.lag(y).over(w).alias("y0"))
    inside = F.when((F.col("x0") < at) & (F.col("x1") >= at), F.col("y0") + (at - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    low = F.when(F.col("x0").isNull() & (F.col("x1") >= at), F.col("y1"))
    found = F.min_by(F.coalesce(low, inside), F.when(F.coalesce(low, inside).isNotNull(), F.col("__o")))
    return rows.groupBy(*keys).agg(F.coalesce(found, F.max_by("y1", "__o")).alias("value"))


def aperture_for_enclosed_flux(cog: DataFrame, enclosed: float = 0.9, keys: tuple[str, ...] = ("frame", "band")) -> DataFrame:
    return interpolate(cog, enclosed, "flux_frac", "radius", keys).withColumnRenamed("value", "aperture")


def aperture_correction(cog: DataFrame, radius: float, keys: tuple[str, ...] = ("frame", "band")) -> DataFrame:
    """Magnitudes to add for the flux outside a radius."""
    return interpolate(cog, radius, "radius", "flux_frac", keys).select(*keys, (2.5 * F.log10("value")).alias("correction"))


def size_aperture(explicit: Column, n_fwhm: Column, fwhm: Column, from_cog: Column, n_stars: Column, least: int = 5) -> Column:
    """An explicit aperture, else a multiple of the width, else the curve's, else 1.2 widths."""
    return F.coalesce(explicit, n_fwhm * fwhm, F.when((n_stars >= least) & is_finite(from_cog), from_cog), 1.2 * fwhm)


def bright_round(rows: DataFrame, snr_min: float = 50.0, masked: int = 0x40) -> DataFrame:
    """Bright, round sources that no mask touches: rows need snr, a, b, flag."""
    return rows.where((F.col("snr") > snr_min) & (F.col("b") / F.when(F.col("a") > 0, F.col("a")) > 0.7) & (F.col("flag").bitwiseAND(masked) == 0))


def point_like(rows: DataFrame, bright: Column, ratio: float = 3.0, keys: tuple[str, ...] = ("frame", "band")) -> DataFrame:
    """Rows no larger than ratio times the median size of the bright ones of their group; all where none is bright."""
    reference = F.median(F.when(bright, F.col("a"))).over(W.partitionBy(*keys))
    return rows.withColumn("__ref", reference).where(F.col("__ref").isNull() | (F.col("a") <= ratio * F.col("__ref"))).drop("__ref")


def median_fwhm(rows: DataFrame, keys: tuple[str, ...] = ("frame", "band")) -> DataFrame:
    return rows.where(is_finite("r_half")).groupBy(*keys).agg((2 * F.median("r_half")).alias("fwhm"))


def stack_report(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """n_in, n_ok, n_bad, resid_median_px, rot_span_deg, total_exptime and reasons of rows (keys, ok, resid, rotation, exptime, reason)."""
    ok = F.col("ok")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_in"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_bad"), F.median(F.when(ok, F.col("resid"))).alias("resid_median_px"),
        (F.max(F.when(ok, F.col("rotation"))) - F.min(F.when(ok, F.col("rotation")))).alias("rot_span_deg"), F.sum(F.when(ok, F.col("exptime"))).alias("total_exptime"),
        F.sort_array(F.collect_set(F.when(~ok, F.col("reason")))).alias("reasons"),
    )


def host_flux(rows: DataFrame, keys: tuple[str, ...] = ("frame",), least: int = 4) -> DataFrame:
    """The host's light from clean azimuths (keys, flux, clean): median (0 below ``least`` of them), scatter (NULL below two) and count."""
    clean = F.when(F.col("clean"), F.col("flux"))
    n = F.count(clean)
    return rows.groupBy(*keys).agg(F.when(n >= least, F.median(clean)).otherwise(0.0).alias("host"), F.when(n > 1, F.stddev_pop(clean)).alias("host_std"), n.alias("n"))
