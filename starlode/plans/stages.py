"""The batch stages: solve, characterise, measure. Each frame is a task's work; what follows is DataFrame plans.

A stage never fails because of a frame: every frame has a row (stage, path, status, message)
with status ok, cached, no_wcs or failed. Stages 1 and 2 skip frames that are done; stage 3
always rebuilds, so that no two aperture regimes mix.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers, scalar
from ..operators import calibrate, depth, ensemble, match
from ..sources.catalogue import _filesystem
from ..sources.fits import load_frame, read_headers
from .project import Project

WCS_SCHEMA = "path string, crpix1 double, crpix2 double, crval1 double, crval2 double, cd11 double, cd12 double, cd21 double, cd22 double, solver string"
STATUS_SCHEMA = "stage string, path string, status string, message string"


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _filesystem(spark, path)
    return system.exists(target)


def table(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def load_tables(spark: SparkSession, project: Project) -> dict[str, DataFrame | None]:
    return {"frames": table(spark, project.frames_path), "stars": table(spark, project.stars_path), "measurements": table(spark, project.measurements_path)}


def pending(keys: DataFrame, done: DataFrame | None) -> DataFrame:
    """The frames that a stage has no row for yet."""
    return keys if done is None else keys.join(done.select("path"), "path", "left_anti")


def status_counts(rows: DataFrame) -> DataFrame:
    """(status, n) of a stage's rows."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def per_frame(keys: DataFrame, work, schema: str, names: list[str], attempts: int = 1, wait_s: float = 5.0) -> DataFrame:
    """Runs ``work(row) -> list of rows`` for each row of ``keys`` (path and what else the work needs); a failure becomes a row
    of the path, its status and message. Missing files and services (OSError) are tried again, ``attempts`` times in all."""
    import time

    def tried(row):
        for k in range(attempts):
            try:
                return work(row)
            except OSError:
                if k + 1 == attempts:
                    raise
                time.sleep(wait_s * (k + 1))
        return []

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                path = row["path"]
                try:
                    rows = [(path, "ok", None, *r) for r in tried(row)]
                except LookupError as e:
                    rows = [(path, "no_wcs", str(e), *[None] * len(names))]
                except Exception as e:
                    rows = [(path, "failed", f"{type(e).__name__}: {e}", *[None] * len(names))]
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "status", "message", *names])

    full = f"path string, status string, message string, {schema}"
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in T._parse_datatype_string(full).fields]
    # A frame is minutes of work: one to a task.
    n = max(1, min(keys.count(), 20 * keys.sparkSession.sparkContext.defaultParallelism))
    return keys.repartition(n).mapInArrow(run, full)


def solved(spark: SparkSession, project: Project, keys: DataFrame) -> DataFrame:
    """``keys`` with their solutions' columns, NULL where there is none."""
    rows = table(spark, project.wcs_path)
    return keys.select("path").join(rows if rows is not None else spark.createDataFrame([], WCS_SCHEMA), "path", "left")


def wcs_from(row: dict):
    from ..pixels.solver import Wcs

    if row["crpix1"] is None:
        raise LookupError("no plate solution")
    return Wcs((row["crpix1"], row["crpix2"]), (row["crval1"], row["crval2"]), np.array([[row["cd11"], row["cd12"]], [row["cd21"], row["cd22"]]]))


def log(spark: SparkSession, project: Project, stage: str, rows: DataFrame) -> dict[str, int]:
    """Appends to the status table and counts by status."""
    rows.select(F.lit(stage).alias("stage"), "path", "status", "message", F.current_timestamp().alias("at")).write.mode("append").parquet(project.status_path)
    return {r["status"]: r["n"] for r in status_counts(rows).collect()}


#: Rows of the largest field that goes to the tasks (32 bytes each).
MOST_STARS = 5_000_000


def catalogue_arrays(project: Project, spark: SparkSession) -> dict[str, np.ndarray]:
    """One field's catalogue for the tasks; over MOST_STARS rows raise ValueError."""
    rows = project.catalogue(spark)
    if rows.count() > MOST_STARS:
        raise ValueError(f"the field has over {MOST_STARS} catalogue rows; lower gmag_limit or half_size_deg")
    rows = rows.orderBy("source_id")
    mag = F.coalesce(F.col("v_jkc_mag").cast("double"), F.lit(float("nan")))
    got = rows.select("source_id", "ra", "dec", mag.alias("mag")).toArrow()
    return {n: got[n].to_numpy() for n in got.column_names}


def solve_all(spark: SparkSession, project: Project, force: bool = False, limit: int | None = None) -> dict[str, int]:
    """Stage 1: a solution for each frame without one (for all with ``force``), into the wcs table."""
    keys, done = project.frames(spark), table(spark, project.wcs_path)
    if not force:
        keys = pending(keys, done)
    if limit is not None:
        keys = keys.orderBy(F.lower("path")).limit(limit)
    keys = keys.select("path")
    stars = spark.sparkContext.broadcast(catalogue_arrays(project, spark) if project.solver == "local" else {"ra": [], "dec": [], "mag": []})
    solver = project.solver

    def work(row):
        from ..pixels.solver import solve

        w = solve(load_frame(row["path"]), solver, stars.value["ra"], stars.value["dec"], stars.value["mag"])
        return [(*map(float, (*w.crpix, *w.crval, *w.cd.ravel())), solver)]

    names = WCS_SCHEMA.replace("path string, ", "")
    rows = per_frame(keys, work, names, [c.split()[0] for c in names.split(", ")], project.attempts, project.wait_s)
    rows.write.mode("overwrite").parquet(project.path("_solve"))
    rows = spark.read.parquet(project.path("_solve"))
    good = rows.where("status = 'ok'").drop("status", "message")
    if done is not None and force:
        good = good.unionByName(done.join(good.select("path"), "path", "left_anti"))
        good.write.mode("overwrite").parquet(project.path("_wcs"))
        spark.read.parquet(project.path("_wcs")).write.mode("overwrite").parquet(project.wcs_path)
    else:
        good.write.mode("append").parquet(project.wcs_path)
    return log(spark, project, "solve", rows)


SOURCE_SCHEMA = "kind string, band string, x double, y double, ra double, dec double, flux double, fluxerr double, snr double, flag int, max_pix_value double, a double, b double, theta double, extra string"
SOURCE_NAMES = [c.split()[0] for c in SOURCE_SCHEMA.split(", ")]


def extract_frames(spark: SparkSession, project: Project, keys: DataFrame) -> DataFrame:
    """Stage 2's pixel work: a row for each source and one (kind frame) with the frame's own figures as JSON."""
    thresh, enclosed, mask_of, isolation, provenance = project.thresh, project.enclosed_characterise, project.mask, project.isolation, project.provenance

    def work(row):
        from ..pixels import photometry as ph

        wcs = wcs_from(row)
        frame = load_frame(row["path"])
        got = ph.extract_sources(frame, thresh, enclosed=enclosed, mask=mask_of(frame, wcs) if mask_of else None, isolation=isolation)
        s, back = got.sources, ph.fit_background(got.background[1])
        ra, dec = wcs.to_world(s["x"], s["y"]) if len(s["x"]) else (np.zeros(0), np.zeros(0))
        own = {f"{n}_{b}": float(v[i]) for n, v in (("fwhm", got.fwhm), ("aperture", got.aperture), ("sky", got.rms)) for i, b in enumerate("RGB")}
        own |= {"sky_pedestal": back["pedestal"], "bg_resid_std": back["resid_std"], "bg_poly": back["coeffs"].tolist(), "enclosed": enclosed}
        own["cog"] = [{"band": b, "radius": float(r), "flux_frac": float(f), "flux_frac_std": float(e), "n_stars": int(c["n_stars"])} for b, c in zip("RGB", got.cogs) for r, f, e in zip(c["radius"], c["flux_frac"], c["flux_frac_std"]) if np.isfinite(f)]
        own["tiles"] = [{"background": float(b), "model": float(m)} for b, m in zip(*ph.background_tiles(got.background[1], back))]
        own = {k: (None if isinstance(v, float) and not np.isfinite(v) else v) for k, v in own.items()}
        if provenance is not None:
            own["provenance"] = json.dumps(provenance(frame))
        rows = [("source", *[v.item() if hasattr(v, "item") else v for v in r], None) for r in zip(s["band"], s["x"], s["y"], ra, dec, *(s[c] for c in ("flux", "fluxerr", "snr", "flag", "max_pix_value", "a", "b", "theta")))]
        return [("frame", *[None] * 13, json.dumps(own)), *rows]

    return per_frame(solved(spark, project, keys), work, SOURCE_SCHEMA, SOURCE_NAMES, project.attempts, project.wait_s)


OWN = ", ".join([f"{n}_{b} double" for n in ("fwhm", "aperture", "sky") for b in "RGB"] + ["sky_pedestal double", "bg_resid_std double", "bg_poly array<double>", "enclosed double", "provenance string"])
OWN_LISTS = "cog array<struct<band: string, radius: double, flux_frac: double, flux_frac_std: double, n_stars: int>>, tiles array<struct<background: double, model: double>>"


def characterise(spark: SparkSession, project: Project, keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, statuses) of the given frames: ``frames`` and the details of Project.DETAILS. Extraction is one scan, cross-match, fit and quality one plan.

    Every frame that was read has a row in ``frames``; one whose calibrators don't make a
    fit has no calibration in it, and status no_fit.
    """
    raw = extract_frames(spark, project, keys)
    aside = project.path("_extract")
    raw.write.mode("overwrite").parquet(aside)
    raw = spark.read.parquet(aside)
    sources = raw.where("kind = 'source'").withColumnRenamed("path", "frame").withColumn("row_key", F.monotonically_increasing_id())
    matched = match.crossmatch(sources, project.catalogue(spark), "row_key", project.match_tol_arcsec)
    matched.write.mode("overwrite").parquet(project.path("_matched"))
    matched = spark.read.parquet(project.path("_matched"))
    extra = raw.where("kind = 'frame'").select(F.col("path"), "extra")
    figures = extra.select("path", F.from_json("extra", OWN).alias("own")).select("path", "own.*")
    lists = extra.select(F.col("path").alias("frame"), F.from_json("extra", OWN_LISTS).alias("own"))
    # One fit for the calibration, the points that it used and the residual figures.
    _, label = calibrate.pick_colour(matched.columns)
    points = calibrate.fit_points(calibrate.calibrators(matched), use_colour=label is not None)
    tables = {
        "frames": quality_rows(figures, read_headers(keys), matched, project),
        "cog": lists.select("frame", F.explode("own.cog").alias("c")).select("frame", "c.*"),
        "tiles": lists.select("frame", F.explode("own.tiles").alias("t")).select("frame", "t.*"),
        "bands": figures.select(F.col("path").alias("frame"), F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"fwhm_{b}").alias("fwhm"), F.col(f"aperture_{b}").alias("aperture"), F.col(f"sky_{b}").alias("rms")) for b in "RGB"])).alias("b")).select("frame", "b.*"),
        "sources": matched.drop("status", "message", "kind", "extra", "row_key"),
        "points": points.select("frame", "v", "colour", "m_inst", "snr", "x_pix", "y_pix", "colour0", "x", "r", "zp", "k", "resid", "used", "keep"),
    }
    found = tables["frames"].select("path", F.col("zeropoint").isNotNull().alias("__fit"))
    statuses = raw.groupBy("path").agg(F.first("status").alias("status"), F.first("message").alias("message")).join(found, "path", "left")
    no_fit = (F.col("status") == "ok") & ~F.coalesce("__fit", F.lit(False))
    return tables, statuses.select("path", F.when(no_fit, "no_fit").otherwise(F.col("status")).alias("status"), F.when(no_fit, "no calibrators").otherwise(F.col("message")).alias("message"))


def with_provenance(rows: DataFrame, project: Project) -> DataFrame:
    """``rows`` with the keys of their JSON texts ``provenance`` as columns of their values' types, in place of columns of the same name."""
    if project.provenance is None:
        return rows.drop("provenance")
    rows.select("provenance").where("provenance IS NOT NULL").write.mode("overwrite").text(project.path("_provenance"))
    kinds = rows.sparkSession.read.json(project.path("_provenance")).schema
    if not kinds.fields:
        return rows.drop("provenance")
    own = rows.withColumn("__own", F.from_json("provenance", kinds)).drop("provenance")
    return own.withColumns({f.name: F.col("__own")[f.name] for f in kinds.fields}).drop("__own")


def quality_rows(figures: DataFrame, heads: DataFrame, matched: DataFrame, project: Project) -> DataFrame:
    """A row for each frame: header metadata, counts, calibration, depth, widths, sky and match quality."""
    meta = heads.select("path", F.element_at(F.split("path", "/"), -1).alias("frame"), "layout", *[c.alias(n) for n, c in headers.frame_metadata().items()], headers.text("header", "TELESCOP").alias("telescope"), headers.pixel_scale().alias("pixscale"), F.coalesce(headers.number("header", "BIAS"), F.lit(0.0)).alias("bias"), headers.frame_times()["mjd_mid"].alias("mjd_mid"))
    # Only the server's figures that some frame's header has.
    present = {r[0] for r in heads.select(F.explode(F.map_keys("header"))).distinct().where(F.col("col").isin(*headers.ONBOARD.values())).collect()}
    onboard = headers.onboard_quality(sorted(present))
    meta = meta.join(heads.select("path", *[c.alias(n) for n, c in onboard.items()]), "path") if onboard else meta
    green = F.col("band") == "G"
    v = F.col(calibrate.pick_v(matched.columns))
    counts = matched.groupBy("frame").agg(F.count("*").alias("n_sources"), F.count_if(green).alias("n_green"), F.count(F.when(green, v)).alias("n_matched"))
    noise = depth.aperture_noise(matched)
    fit = calibrate.fit_zeropoint(matched).withColumnRenamed("n_stars", "n_cal").drop("band", "colour_label")
    sat = calibrate.saturation_mag(matched.where(green))
    quality = match.match_quality(matched.where(green), project.match_tol_arcsec, ("frame",)).withColumnRenamed("n", "match_n")
    rows = figures.join(meta, "path").withColumnRenamed("frame", "__name").withColumn("frame", F.col("path"))
    for part in (counts, noise, fit, sat, quality):
        rows = rows.join(part, "frame", "left")
    rows = rows.drop("frame").withColumnRenamed("__name", "frame").fillna(0, ["n_sources", "n_green", "n_matched", "n_cal", "match_n"])
    sky_sb = scalar.sky_surface_brightness("sky_pedestal", "zeropoint", "pixscale", F.col("bias"))
    rows = rows.withColumn("v_lim_5sigma", scalar.limiting_mag("zeropoint", "sigma_aper")).withColumn("v_lim_100sigma", scalar.limiting_mag("zeropoint", "sigma_aper", 100.0))
    rows = rows.withColumn("sky_sb", sky_sb).withColumn("bortle", scalar.effective_bortle("sky_sb")).withColumn("solver", F.lit(project.solver)).drop("bias")
    return with_provenance(rows, project)


def merge(spark: SparkSession, project: Project, name: str, rows: DataFrame, keys: DataFrame, by: str, replace: bool) -> None:
    """Adds rows to a project's table; with ``replace`` those of ``keys`` first go from it."""
    path, done = project.path(name), table(spark, project.path(name))
    if done is None or not replace:
        rows.write.mode("append").parquet(path)
        return
    kept = done.join(keys.select(F.col("path").alias(by)), by, "left_anti")
    rows.unionByName(kept, allowMissingColumns=True).write.mode("overwrite").parquet(project.path(f"_{name}"))
    spark.read.parquet(project.path(f"_{name}")).write.mode("overwrite").parquet(path)


def add_frames(spark: SparkSession, project: Project, keys: DataFrame, replace: bool = False) -> dict[str, int]:
    """Characterises frames, writes their rows into the project's tables and returns the counts by status."""
    tables, statuses = characterise(spark, project, keys)
    statuses.write.mode("overwrite").parquet(project.path("_statuses"))
    for name in Project.DETAILS:
        merge(spark, project, name, tables[name], keys, "frame", replace)
    # The frames' own table last: a frame that has a row there is done.
    merge(spark, project, "frames", tables["frames"], keys, "path", replace)
    return log(spark, project, "characterise", spark.read.parquet(project.path("_statuses")))


def build_frame_table(spark: SparkSession, project: Project, force: bool = False, limit: int | None = None) -> DataFrame:
    """Stage 2: adds a row for each frame that has none; with ``force`` also computes the others anew, keeping what isn't."""
    keys, done = project.frames(spark), table(spark, project.frames_path)
    if not force:
        keys = pending(keys, done)
    if limit is not None:
        keys = keys.orderBy(F.lower("path")).limit(limit)
    if keys.limit(1).count():
        add_frames(spark, project, keys.select("path"), force)
    return sorted_frames(spark.read.option("mergeSchema", "true").parquet(project.frames_path))


def sorted_frames(frames: DataFrame, *then: str) -> DataFrame:
    """All frames by unit and start."""
    return frames.orderBy("unit", "date_obs", *then)


MEASURE_SCHEMA = "source_id bigint, band string, x double, y double, flux double, fluxerr double, snr double, flag int, on_chip boolean, max_pix_value double"
MEASURE_NAMES = [c.split()[0] for c in MEASURE_SCHEMA.split(", ")]


def measure_frames(spark: SparkSession, project: Project, keys: DataFrame) -> DataFrame:
    """Stage 3's pixel work: forced photometry of every catalogue source in the footprint of each frame."""
    stars = spark.sparkContext.broadcast(catalogue_arrays(project, spark))
    thresh, enclosed, mask_of, isolation = project.thresh, project.enclosed_lightcurve, project.mask, project.isolation

    def work(row):
        from ..pixels import photometry as ph

        wcs = wcs_from(row)
        frame = load_frame(row["path"])
        x, y = wcs.to_pixel(stars.value["ra"], stars.value["dec"])
        ny, nx = frame.shape
        on = (x >= 0) & (x < nx) & (y >= 0) & (y < ny)
        got = ph.forced_photometry(frame, x[on], y[on], stars.value["source_id"][on], thresh, enclosed=enclosed, mask=mask_of(frame, wcs) if mask_of else None, isolation=isolation).sources
        clean = lambda v: None if isinstance(v, float) and not np.isfinite(v) else v
        return [tuple(clean(v.item() if hasattr(v, "item") else v) for v in r) for r in zip(*(got[c] for c in MEASURE_NAMES))]

    return per_frame(solved(spark, project, keys), work, MEASURE_SCHEMA, MEASURE_NAMES, project.attempts, project.wait_s)


def build_measurements(spark: SparkSession, project: Project, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Stage 3: rebuilds (stars, measurements). Magnitudes are calibrated in green by each frame's fit."""
    keys = project.frames(spark)
    keys = keys.limit(limit) if limit is not None else keys
    raw = measure_frames(spark, project, keys)
    raw.write.mode("overwrite").parquet(project.path("_forced"))
    raw = spark.read.parquet(project.path("_forced"))
    log(spark, project, "measure", raw.groupBy("path").agg(F.first("status").alias("status"), F.first("message").alias("message")))
    catalogue = project.catalogue(spark)
    rows = raw.where("status = 'ok'").withColumnRenamed("path", "frame").drop("status", "message")
    columns = [c for c in ensemble.STAR_COLUMNS if c in catalogue.columns and c not in ("ra", "dec")]
    fit = calibrate.fit_zeropoint(rows.where("on_chip").join(catalogue.select(*columns), "source_id"))
    times = headers.frame_times("header", F.lit(project.target.ra), F.lit(project.target.dec))
    when = read_headers(keys).select(F.col("path").alias("frame"), *[times[c].alias(c) for c in ("mjd_obs", "mjd_mid", "bjd_tdb", "airmass", "time_source")])
    colour, _ = calibrate.pick_colour(catalogue.columns)
    out = rows.join(fit.select("frame", "zeropoint", "colour_term", "colour0", F.col("rms").alias("zp_rms")), "frame").join(when, "frame")
    out = out.join(catalogue.select("source_id", (colour if colour is not None else F.lit(None).cast("double")).alias("__colour")), "source_id")
    out = out.withColumn("m_inst", scalar.instrumental_mag("flux")).withColumn("mag_err", scalar.mag_error("snr"))
    mag = scalar.apply_calibration("m_inst", "zeropoint", "colour_term", F.coalesce("__colour", "colour0"), "colour0")
    out = out.withColumn("mag", F.when(F.col("band") == "G", mag)).select(
        "source_id", "frame", "band", "mjd_obs", "mjd_mid", "bjd_tdb", "airmass", "x", "y", "flux", "fluxerr", "snr", "m_inst", "mag", "mag_err", "flag", "on_chip", "max_pix_value", "zeropoint", "zp_rms", "time_source",
    )
    out.repartition("band", "source_id").sortWithinPartitions("source_id", "band", "mjd_mid").write.mode("overwrite").partitionBy("band").parquet(project.measurements_path)
    measurements = spark.read.parquet(project.measurements_path)
    ensemble.build_stars(catalogue, measurements, *project.target.radec, project.target.source_id).write.mode("overwrite").parquet(project.stars_path)
    return spark.read.parquet(project.stars_path), measurements


def sources_in_frames(catalogue: DataFrame, frames: DataFrame, margin: float = 0.0) -> DataFrame:
    """(path, source_id, x, y) of catalogue rows inside each frame (path, ny, nx and a solution's columns).

    Rows and pointings meet in cells of the sphere as wide as the largest frame's reach, and
    are cut by their distance before they are projected.
    """
    from ..functions.sky import world_to_pixel

    w = {k: f"__{k}" for k in ("crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22")}
    # To the corner farthest from the reference pixel, on the tangent plane.
    far = lambda size, ref: F.greatest(F.abs(F.col(ref) - 1) + margin, F.abs(F.col(size) - F.col(ref)) + margin)
    scale = F.sqrt(F.greatest(F.pow("cd11", F.lit(2)) + F.pow("cd21", F.lit(2)), F.pow("cd12", F.lit(2)) + F.pow("cd22", F.lit(2))))
    plane = (far("nx", "crpix1") + far("ny", "crpix2")) * scale
    reach = F.degrees(F.atan(F.radians(plane))) * 1.001
    side = frames.select("path", "ny", "nx", reach.alias("__reach"), *[F.col(k).alias(v) for k, v in w.items()])
    widest = side.agg(F.max("__reach")).first()[0]
    if widest is None:
        widest = 1.0
    pairs = match.near_pairs(catalogue.select("source_id", "ra", "dec"), side, min(widest, 180.0), right_pos=("__crval1", "__crval2"))
    near = pairs.where(F.col("sep_arcsec") <= F.col("__reach") * 3600.0)
    x, y = world_to_pixel("ra", "dec", w)
    near = near.withColumn("x", x).withColumn("y", y)
    inside = (F.col("x") >= -margin) & (F.col("x") < F.col("nx") + margin) & (F.col("y") >= -margin) & (F.col("y") < F.col("ny") + margin)
    return near.where(inside).select("path", "source_id", "x", "y")


def in_any_frame(catalogue: DataFrame, frames: DataFrame, margin: float = 0.0) -> DataFrame:
    """The catalogue rows inside one frame at least."""
    return catalogue.join(sources_in_frames(catalogue, frames, margin).select("source_id").distinct(), "source_id", "left_semi")
