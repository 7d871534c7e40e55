"""Zero points: the clipped colour fit of every frame in one plan, its points, and saturation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import MAG_PER_SNR, SAT_LEVEL, instrumental_mag, is_finite

FIT_MAG_RANGE = (10.0, 14.0)


def pick_v(columns: Sequence[str]) -> str:
    for name in ("v_jkc_mag", "v_mag"):
        if name in columns:
            return name
    raise KeyError("no V magnitude column (v_jkc_mag or v_mag)")


def pick_colour(columns: Sequence[str]) -> tuple[Column | None, str | None]:
    """The colour that the columns allow, and its label."""
    for b, r in (("b_jkc_mag", "r_jkc_mag"), ("b_mag", "r_mag")):
        if b in columns and r in columns:
            return F.col(b).cast("double") - F.col(r).cast("double"), "B-R"
    return (F.col("bp_rp").cast("double"), "BP-RP") if "bp_rp" in columns else (None, None)


def calibrators(sources: DataFrame, band: str = "G", mag_range=FIT_MAG_RANGE, exclude_variable: bool = True, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, v, colour, m_inst, snr[, x_pix, y_pix]) of the rows that a fit may use; the pixels are the sources' x and y."""
    v = F.col(pick_v(sources.columns)).cast("double")
    colour, _ = pick_colour(sources.columns)
    out = sources.where(F.col("band") == band).withColumn("v", v).withColumn("colour", colour if colour is not None else F.lit(None).cast("double"))
    out = out.where(is_finite("v") & (F.col("flux") > 0))
    if colour is not None:
        out = out.where(is_finite("colour"))
    if exclude_variable and "phot_variable_flag" in sources.columns:
        out = out.where(F.coalesce(F.col("phot_variable_flag") != "VARIABLE", F.lit(True)))
    if mag_range is not None:
        out = out.where(F.col("v").between(*mag_range))
    out = out.withColumn("m_inst", instrumental_mag("flux"))
    return out.select(*keys, "v", "colour", "m_inst", "snr", *[F.col(c).alias(f"{c}_pix") for c in ("x", "y") if c in out.columns])


def fit_points(points: DataFrame, clip: float = 3.0, iters: int = 2, keys: Sequence[str] = ("frame",), use_colour: bool = True) -> DataFrame:
    """Every point with its fit: adds x (colour - colour0), zp, k, resid, used (in the last fit) and keep (after the last clip).

    iters + 1 least-squares fits; after each, the points within clip times the scatter of
    those used are used next, earlier ones re-admitted. Fits are window sums over the keys,
    so all passes share one shuffle.
    """
    w = W.partitionBy(*keys)
    c0 = F.median("colour").over(w) if use_colour else F.lit(None).cast("double")
    rows = points.withColumn("colour0", c0).withColumn("x", F.col("colour") - F.col("colour0") if use_colour else F.lit(0.0)).withColumn("r", F.col("v") - F.col("m_inst")).withColumn("used", F.lit(True))
    for step in range(iters + 1):
        if step:
            rows = rows.withColumn("used", F.col("keep"))
        on = F.col("used")
        rows = rows.withColumn("n_used", F.count(F.when(on, 1)).over(w)).withColumn("mx", F.avg(F.when(on, F.col("x"))).over(w)).withColumn("mr", F.avg(F.when(on, F.col("r"))).over(w))
        dx, dr = F.col("x") - F.col("mx"), F.col("r") - F.col("mr")
        rows = rows.withColumn("sxx", F.sum(F.when(on, dx * dx)).over(w)).withColumn("sxr", F.sum(F.when(on, dx * dr)).over(w))
        k = F.when(F.col("sxx") > 0, F.col("sxr") / F.col("sxx")) if use_colour else F.lit(0.0)
        rows = rows.withColumn("k", k).withColumn("zp", F.col("mr") - F.col("k") * F.col("mx")).withColumn("resid", F.col("r") - F.col("zp") - F.col("k") * F.col("x"))
        rows = rows.withColumn("scatter", F.stddev_pop(F.when(on, F.col("resid"))).over(w)).withColumn("keep", F.coalesce(F.abs("resid") < clip * F.col("scatter"), F.lit(False)))
    return rows


def summarise(points: DataFrame, keys: Sequence[str] = ("frame",), use_colour: bool = True) -> DataFrame:
    """One row for each fit: coefficients and errors of the last fit, counts, rms and reduced chi-square of the points kept after it.

    A fit without three points, or whose last clip keeps none, has no row.
    """
    on, keep = F.col("used"), F.col("keep")
    n = F.count(F.when(on, 1))
    n_par = 2 if use_colour else 1
    error = F.col("resid") * F.col("snr") / MAG_PER_SNR
    out = points.groupBy(*keys).agg(
        F.first("zp").alias("zeropoint"), F.first("k").alias("colour_term"), F.first("colour0").alias("colour0"), F.first("sxx").alias("sxx"), F.first("mx").alias("mx"),
        n.alias("n_fit"), F.sum(F.when(on, F.col("resid") * F.col("resid"))).alias("sse"), F.first("scatter").alias("scatter"),
        F.count(F.when(keep, 1)).alias("n_stars"), F.stddev_pop(F.when(keep, F.col("resid"))).alias("rms"), F.sum(F.when(keep, error * error)).alias("chi2"),
        F.stddev_pop(F.when(keep, F.col("r"))).alias("spread"),
    )
    out = out.where((F.col("n_fit") > (2 if use_colour else 0)) & (F.col("n_stars") > 0))
    s2 = F.col("sse") / F.when(F.col("n_fit") > 2, F.col("n_fit") - 2)
    if use_colour:
        zp_err, k_err = F.sqrt(s2 * (1 / F.col("n_fit") + F.col("mx") * F.col("mx") / F.col("sxx"))), F.sqrt(s2 / F.col("sxx"))
    else:
        zp_err, k_err = F.col("spread") / F.sqrt("n_stars"), F.lit(0.0)
    return out.select(*keys, "zeropoint", zp_err.alias("zeropoint_err"), "colour_term", k_err.alias("colour_term_err"), "colour0", "n_stars", "rms", (F.col("chi2") / F.greatest(F.col("n_stars") - n_par, F.lit(1))).alias("chi2_red"))


def fit_zeropoint(sources: DataFrame, band: str = "G", mag_range=FIT_MAG_RANGE, clip: float = 3.0, iters: int = 2, exclude_variable: bool = True, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """The zero point and colour term of every frame; without a colour column, the clipped mean."""
    _, label = pick_colour(sources.columns)
    points = fit_points(calibrators(sources, band, mag_range, exclude_variable, keys), clip, iters, keys, label is not None)
    out = summarise(points, keys, label is not None).withColumn("band", F.lit(band)).withColumn("colour_label", F.lit(label))
    low, high = mag_range if mag_range is not None else (None, None)
    return out.withColumn("fit_mag_lo", F.lit(low).cast("double")).withColumn("fit_mag_hi", F.lit(high).cast("double"))


def saturation_mag(sources: DataFrame, keys: Sequence[str] = ("frame",), level: float = SAT_LEVEL) -> DataFrame:
    """v_sat: the faintest matched star whose peak reaches the level; NULL if none does."""
    v = F.col(pick_v(sources.columns)).cast("double")
    return sources.groupBy(*keys).agg(F.max(F.when(is_finite(v) & (F.col("max_pix_value") >= level), v)).alias("v_sat"))
