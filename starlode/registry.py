"""The engine's queries over the driver's tables, by name, and the SQL that must give the same rows.

The tables are not astronomical, so views stand in: grouped ``events`` for measurements,
``customer`` for stars, ``orders`` for frames, ``lineitem`` for calibrator observations and
``embeddings`` for sky positions. Each has an expression here and its SQL in ``VIEWS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar, sky
from .operators import calibrate, depth, diagnostics, ensemble, growth, match, period, solve
from .plans import stages
from .sources import catalogue
from .workspace import fresh_path

QUERIES: dict = {}
ORACLE: dict = {}

VIEWS = {
    "meas": """SELECT source_id, frame, band, flux, n, time, -2.5 * log10(flux) AS m_inst, 1.0857 / sqrt(flux) AS mag_err, CASE WHEN n > 2 THEN 1 ELSE 0 END AS flag
        FROM (SELECT user_id AS source_id, strftime(ts, '%Y-%m-%d') AS frame, event_type AS band, sum(value) AS flux, count(*) AS n,
              epoch_us(min(ts)) / 86400000000.0 - 19723 AS time FROM events GROUP BY 1, 2, 3) WHERE flux > 0""",
    "stars": """SELECT c_custkey AS source_id, 10 + (c_acctbal - 4 * floor(c_acctbal / 4)) AS v_jkc_mag, 0.5 + 0.02 * c_nationkey AS bp_rp,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'VARIABLE' ELSE 'NOT_AVAILABLE' END AS phot_variable_flag, c_nationkey * 1.0 AS sep_target_arcmin, c_custkey = 7 AS is_target
        FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""",
    "frames": """SELECT o_orderkey AS frame, o_orderpriority AS unit, o_orderstatus AS model, o_orderdate AS date_obs, 14 + (o_totalprice - 4 * floor(o_totalprice / 4)) AS v_lim_5sigma,
        0.1 * ((o_custkey % 100) / 100.0) AS rms, 300.0 * (1 + o_custkey % 12) AS total_exptime, 18 + (o_custkey % 37) / 12.0 AS sky_sb, 2 + (o_orderkey % 29) / 10.0 AS fwhm_G FROM orders""",
    "obs": """SELECT strftime(l_shipdate, '%Y-%m') AS frame, l_returnflag AS band, l_extendedprice AS flux, sqrt(l_extendedprice) AS snr, l_quantity AS x, l_discount * 10 AS bp_rp,
        22 - 2.5 * log10(l_extendedprice) + 0.12 * l_discount * 10 + (l_tax - 0.04) + CASE WHEN l_quantity > 49 THEN 0.5 ELSE 0 END AS v_jkc_mag,
        l_extendedprice * 0.7 AS max_pix_value FROM lineitem WHERE l_extendedprice > 0""",
    "sky": """SELECT vec_id, degrees(atan2(e2, e1)) + 180 AS ra, degrees(asin(greatest(-1.0, least(1.0, e3 / sqrt(e1 * e1 + e2 * e2 + e3 * e3))))) AS dec, label
        FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, embedding[3]::DOUBLE AS e3 FROM embeddings)""",
    # A field of 18 by 9 degrees, and 25 pointings over the sky.
    "field": "SELECT vec_id, 120 + (ra - 180) / 20 AS ra, 10 + dec / 20 AS dec, label FROM sky",
    "pointings": "SELECT n_name AS path, 14.4 * n_nationkey AS a0, 6.0 * n_nationkey - 72 AS d0 FROM nation",
    "placed": """SELECT path, vec_id, 199 + degrees(cos(radians(dec)) * sin(radians(ra - a0)) / den) / -0.05 AS x,
        149 + degrees((cos(radians(d0)) * sin(radians(dec)) - sin(radians(d0)) * cos(radians(dec)) * cos(radians(ra - a0))) / den) / 0.05 AS y
        FROM (SELECT *, sin(radians(d0)) * sin(radians(dec)) + cos(radians(d0)) * cos(radians(dec)) * cos(radians(ra - a0)) AS den FROM sky, pointings) WHERE den > 0""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positive_rest(c: str, m: int):
    return F.col(c) - m * F.floor(F.col(c) / m)


def meas(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    time = F.unix_micros(F.min("ts").cast("timestamp")) / 86400e6 - 19723
    g = e.groupBy(F.col("user_id").alias("source_id"), day.alias("frame"), F.col("event_type").alias("band")).agg(F.sum("value").alias("flux"), F.count("*").alias("n"), time.alias("time"))
    return g.where("flux > 0").withColumn("m_inst", scalar.instrumental_mag("flux")).withColumn("mag_err", scalar.mag_error(F.sqrt("flux"))).withColumn("flag", F.when(F.col("n") > 2, 1).otherwise(0))


def stars(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").join(read(spark, d, "events").select("user_id").distinct(), F.col("c_custkey") == F.col("user_id"), "left_semi")
    return c.select(
        F.col("c_custkey").alias("source_id"), (10 + positive_rest("c_acctbal", 4)).alias("v_jkc_mag"), (0.5 + 0.02 * F.col("c_nationkey")).alias("bp_rp"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "VARIABLE").otherwise("NOT_AVAILABLE").alias("phot_variable_flag"),
        F.col("c_nationkey").cast("double").alias("sep_target_arcmin"), (F.col("c_custkey") == 7).alias("is_target"),
    )


def frames(spark: SparkSession, d: str) -> DataFrame:
    cust = F.col("o_custkey")
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("frame"), F.col("o_orderpriority").alias("unit"), F.col("o_orderstatus").alias("model"), F.col("o_orderdate").alias("date_obs"),
        (14 + positive_rest("o_totalprice", 4)).alias("v_lim_5sigma"), (0.1 * ((cust % 100) / 100.0)).alias("rms"), (300.0 * (1 + cust % 12)).alias("total_exptime"),
        (18 + (cust % 37) / 12.0).alias("sky_sb"), (2 + (F.col("o_orderkey") % 29) / 10.0).alias("fwhm_G"),
    )


def obs(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return read(spark, d, "lineitem").where("l_extendedprice > 0").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("frame"), F.col("l_returnflag").alias("band"), price.alias("flux"), F.sqrt(price).alias("snr"), F.col("l_quantity").alias("x"),
        (F.col("l_discount") * 10).alias("bp_rp"), (22 - 2.5 * F.log10(price) + 0.12 * F.col("l_discount") * 10 + (F.col("l_tax") - 0.04) + F.when(F.col("l_quantity") > 49, 0.5).otherwise(0.0)).alias("v_jkc_mag"),
        (price * 0.7).alias("max_pix_value"),
    )


def sky_points(spark: SparkSession, d: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    norm = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])
    z = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), e[2] / norm))
    return read(spark, d, "embeddings").select("vec_id", (F.degrees(F.atan2(e[1], e[0])) + 180).alias("ra"), F.degrees(F.asin(z)).alias("dec"), "label")


def field_points(spark: SparkSession, d: str) -> DataFrame:
    p = sky_points(spark, d)
    return p.select("vec_id", (120 + (F.col("ra") - 180) / 20).alias("ra"), (10 + F.col("dec") / 20).alias("dec"), "label")


def catalogue_rows(points: DataFrame, id_: str = "vec_id", v: str = "label") -> DataFrame:
    """Points as catalogue rows: ids begin with the pixel of their position."""
    ident = F.shiftleft(F.col("__pixel").cast("long"), 49) + F.expr(id_)
    return sky.with_pixel(points, "__pixel").select(ident.alias("source_id"), "ra", "dec", F.expr(v).cast("float").alias("v_jkc_mag"))


def vec_of(column: str = "source_id"):
    return F.col(column).bitwiseAND((1 << 49) - 1)


def pointings(spark: SparkSession, d: str) -> DataFrame:
    key, fixed = F.col("n_nationkey"), {"crpix1": 200.0, "crpix2": 150.0, "cd11": -0.05, "cd12": 0.0, "cd21": 0.0, "cd22": 0.05}
    return read(spark, d, "nation").select(F.col("n_name").alias("path"), F.lit(300).alias("ny"), F.lit(400).alias("nx"), (14.4 * key).alias("crval1"), (6.0 * key - 72).alias("crval2"), *[F.lit(v).alias(k) for k, v in fixed.items()])


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a query and its SQL, which may use the named views."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = ("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split()) + " " if views else "") + sql
        return f

    return add


def joined(sql: str, before: str) -> str:
    """SQL whose own CTEs follow the views'."""
    return f", {before} {sql}"


SEP = "degrees(2 * asin(sqrt(least(greatest(pow(sin(radians({d1} - {d0}) / 2), 2) + cos(radians({d0})) * cos(radians({d1})) * pow(sin(radians({a1} - {a0}) / 2), 2), 0), 1))))"

# ------------------------------------------------------------------ scalars

@query("fn01_instrumental_mag", "SELECT l_orderkey, l_linenumber, round(-2.5 * log10(l_extendedprice), 6) + 0.0 AS m_inst FROM lineitem WHERE l_extendedprice > 0")
def fn01(s, d):
    return rounded(read(s, d, "lineitem").where("l_extendedprice > 0").select("l_orderkey", "l_linenumber", scalar.instrumental_mag("l_extendedprice").alias("m_inst")), "m_inst")


@query("fn02_mag_error", "SELECT l_orderkey, CASE WHEN l_discount > 0 THEN round(1.0857 / l_discount, 6) END AS mag_err FROM lineitem")
def fn02(s, d):
    return rounded(read(s, d, "lineitem").select("l_orderkey", scalar.mag_error("l_discount").alias("mag_err")), "mag_err")


@query("fn03_apply_calibration", "SELECT l_orderkey, round(-2.5 * log10(l_extendedprice) + 22 + 0.12 * (l_discount * 10 - 0.5), 6) + 0.0 AS mag FROM lineitem")
def fn03(s, d):
    m = scalar.apply_calibration(scalar.instrumental_mag("l_extendedprice"), F.lit(22.0), F.lit(0.12), F.col("l_discount") * 10, F.lit(0.5))
    return rounded(read(s, d, "lineitem").select("l_orderkey", m.alias("mag")), "mag")


@query("fn04_limiting_mag", "SELECT l_orderkey, round(22 - 2.5 * log10(5 * l_quantity), 6) AS v5, round(22 - 2.5 * log10(100 * l_quantity), 6) AS v100 FROM lineitem")
def fn04(s, d):
    q = F.col("l_quantity")
    return rounded(read(s, d, "lineitem").select("l_orderkey", scalar.limiting_mag(F.lit(22.0), q).alias("v5"), scalar.limiting_mag(F.lit(22.0), q, 100.0).alias("v100")), "v5", "v100")


@query("fn05_sky_brightness", "SELECT p_partkey, CASE WHEN p_retailprice - 950 > 0 THEN round(21.5 - 2.5 * log10((p_retailprice - 950) / (2.39 * 2.39)), 6) END AS sky_sb FROM part")
def fn05(s, d):
    return rounded(read(s, d, "part").select("p_partkey", scalar.sky_surface_brightness(F.col("p_retailprice"), F.lit(21.5), F.lit(2.39), 950.0).alias("sky_sb")), "sky_sb")


@query("fn06_bortle", "SELECT frame, CASE WHEN sky_sb >= 21.75 THEN 1.0 WHEN sky_sb >= 21.5 THEN 2.0 WHEN sky_sb >= 21.25 THEN 3.0 WHEN sky_sb >= 20.5 THEN 4.0 WHEN sky_sb >= 19.5 THEN 5.0 WHEN sky_sb >= 18.75 THEN 6.0 WHEN sky_sb >= 18.0 THEN 7.0 WHEN sky_sb >= 17.0 THEN 8.0 ELSE 9.0 END::DOUBLE AS bortle FROM frames", "frames")
def fn06(s, d):
    return frames(s, d).select("frame", scalar.effective_bortle("sky_sb").alias("bortle"))


@query("fn07_scale_limit", "SELECT frame, round(v_lim_5sigma + 1.25 * log10(900.0 / total_exptime), 6) AS v_ref FROM frames", "frames")
def fn07(s, d):
    return rounded(frames(s, d).select("frame", scalar.scale_limit("v_lim_5sigma", "total_exptime").alias("v_ref")), "v_ref")


@query("fn08_haversine", f"SELECT vec_id, round({SEP.format(a0=186.6821, d0=81.474, a1='ra', d1='dec')}, 6) AS sep FROM sky", "sky")
def fn08(s, d):
    return rounded(sky_points(s, d).select("vec_id", sky.separation_deg(186.6821, 81.474, "ra", "dec").alias("sep")), "sep")


@query("fn09_hpx", "SELECT l_orderkey, ((l_orderkey * 1000003 * 65536) >> 49)::INT AS hpx5 FROM lineitem")
def fn09(s, d):
    return read(s, d, "lineitem").select("l_orderkey", scalar.hpx_of(F.col("l_orderkey") * 1000003 * 65536).alias("hpx5"))


@query("fn10_epoch", """SELECT vec_id, round((ra + pm * 10 / 3.6e6 / greatest(cos(radians(dec)), 1e-8)) - 360 * floor((ra + pm * 10 / 3.6e6 / greatest(cos(radians(dec)), 1e-8)) / 360), 6) AS ra, round(dec + coalesce(-pm, 0) * 10 / 3.6e6, 6) + 0.0 AS dec
    FROM (SELECT *, label * 1000.0 AS pm FROM sky)""", "sky")  # fmt: skip
def fn10(s, d):
    p = sky_points(s, d).withColumn("pm", F.col("label") * 1000.0)
    ra, dec = sky.propagate_epoch("ra", "dec", "pm", -F.col("pm"), 2026.0)
    return rounded(p.select("vec_id", ra.alias("ra"), dec.alias("dec")), "ra", "dec")


@query("fn18_phase_fold", "SELECT source_id, frame, band, round((time / 0.37) - floor(time / 0.37), 6) AS phase FROM meas", "meas")
def fn18(s, d):
    return rounded(meas(s, d).select("source_id", "frame", "band", scalar.phase_fold("time", 0.37, 0.0).alias("phase")), "phase")


@query("fn21_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def fn21(s, d):
    return read(s, d, "part").select("p_partkey", scalar.slug("p_name").alias("slug"))


@query("fn26_vote_threshold", "SELECT p_partkey, round(greatest(8.0, e + 8 * sqrt(e)), 6) AS votes FROM (SELECT p_partkey, p_size * 20.0 * 250 / pow(2 * 500.0 / 32, 2) AS e FROM part)")
def fn26(s, d):
    return rounded(read(s, d, "part").select("p_partkey", scalar.vote_threshold(F.col("p_size") * 20.0, F.lit(250), F.lit(500.0)).alias("votes")), "votes")


@query("fn30_tan_projection", """SELECT vec_id, CASE WHEN den > 0 THEN round(209 + degrees(cos(radians(dec)) * sin(radians(ra - 180)) / den) / -0.5, 4) + 0.0 END AS x,
    CASE WHEN den > 0 THEN round(189 + degrees((cos(radians(20.0)) * sin(radians(dec)) - sin(radians(20.0)) * cos(radians(dec)) * cos(radians(ra - 180))) / den) / 0.5, 4) + 0.0 END AS y
    FROM (SELECT *, sin(radians(20.0)) * sin(radians(dec)) + cos(radians(20.0)) * cos(radians(dec)) * cos(radians(ra - 180)) AS den FROM sky) WHERE den > 0.05""", "sky")  # fmt: skip
def fn30(s, d):
    w = dict(crpix1=F.lit(210.0), crpix2=F.lit(190.0), crval1=F.lit(180.0), crval2=F.lit(20.0), cd11=F.lit(-0.5), cd12=F.lit(0.0), cd21=F.lit(0.0), cd22=F.lit(0.5))
    x, y = sky.world_to_pixel("ra", "dec", w)
    den = F.sin(F.radians(F.lit(20.0))) * F.sin(F.radians("dec")) + F.cos(F.radians(F.lit(20.0))) * F.cos(F.radians("dec")) * F.cos(F.radians(F.col("ra") - 180))
    return rounded(sky_points(s, d).where(den > 0.05).select("vec_id", x.alias("x"), y.alias("y")), "x", "y", digits=4)


# ------------------------------------------------------------------ filters and projections

@query("flt02_photometric", "SELECT frame, round(rms, 6) AS rms FROM frames WHERE rms < 0.06", "frames")
def flt02(s, d):
    return rounded(depth.photometric(frames(s, d)).select("frame", "rms"), "rms")


COMPS = """comps AS (SELECT st.* FROM stars st, (SELECT v_jkc_mag AS tv, bp_rp AS tc FROM stars WHERE is_target) t
    WHERE st.source_id <> 7 AND abs(st.v_jkc_mag - t.tv) <= 1.5 AND abs(st.bp_rp - t.tc) <= 0.4 AND st.phot_variable_flag <> 'VARIABLE')"""


def comparisons(s, d) -> DataFrame:
    return ensemble.select_comparisons(stars(s, d), dmag=1.5, colour_tol=0.4)


@query("flt06_select_comparisons", joined("SELECT source_id, round(v_jkc_mag, 6) AS v_jkc_mag, round(bp_rp, 6) AS bp_rp FROM comps", COMPS), "stars")
def flt06(s, d):
    return rounded(comparisons(s, d).select("source_id", "v_jkc_mag", "bp_rp"), "v_jkc_mag", "bp_rp")


@query("flt07_valid_measurements", "SELECT source_id, frame, n FROM meas WHERE band = 'click' AND flag <= 0", "meas")
def flt07(s, d):
    return ensemble.valid(meas(s, d), "click").select("source_id", "frame", "n")


@query("flt16_semi", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def flt16(s, d):
    measured = read(s, d, "lineitem").where("l_quantity > 45").withColumnRenamed("l_partkey", "source_id")
    return ensemble.measured_rows(read(s, d, "part").withColumnRenamed("p_partkey", "source_id"), measured).select(F.col("source_id").alias("p_partkey"), "p_name")


@query("flt17_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def flt17(s, d):
    done = read(s, d, "lineitem").where("l_quantity > 25").withColumnRenamed("l_orderkey", "path")
    return stages.pending(read(s, d, "orders").withColumnRenamed("o_orderkey", "path"), done).select(F.col("path").alias("o_orderkey"))


@query("prj07_conform_flag", "SELECT c_custkey, lower(c_mktsegment) IN ('true', 't', '1', 'yes') AS as_text, c_nationkey = 1 AS as_number FROM customer")
def prj07(s, d):
    return read(s, d, "customer").select("c_custkey", scalar.conform_flag("c_mktsegment").alias("as_text"), scalar.conform_flag("c_nationkey").alias("as_number"))


# ------------------------------------------------------------------ ensemble photometry

def lc_sql(out: str) -> str:
    return joined(out, f"""{COMPS}, good AS (SELECT * FROM meas WHERE band = 'click' AND flag <= 0),
    zp AS (SELECT frame, avg(z) AS zp_ens, coalesce(stddev_samp(z), 0) AS zp_scatter, count(*) AS n_comp FROM (SELECT g.frame, c.v_jkc_mag - g.m_inst AS z FROM good g JOIN comps c USING (source_id)) GROUP BY frame HAVING count(*) >= 3),
    lc0 AS (SELECT t.time, t.m_inst + zp_ens AS mag, sqrt(pow(t.mag_err, 2) + pow(zp_scatter / sqrt(n_comp), 2)) AS mag_err, zp_ens, zp_scatter, n_comp, frame FROM good t JOIN zp USING (frame) WHERE t.source_id = 7),
    lc AS (SELECT *, mag - (SELECT median(mag) FROM lc0) AS dmag FROM lc0)""")  # fmt: skip


def lightcurve(s, d) -> DataFrame:
    return ensemble.differential_lightcurve(meas(s, d), 7, comparisons(s, d), band="click", time_col="time")


@query("agg01_ensemble_lc", lc_sql("SELECT frame, round(time, 6) AS time, round(mag, 6) AS mag, round(mag_err, 6) AS mag_err, round(zp_ens, 6) AS zp_ens, round(zp_scatter, 6) AS zp_scatter, n_comp FROM lc"), "meas stars")
def agg01(s, d):
    return rounded(lightcurve(s, d).select("frame", "time", "mag", "mag_err", "zp_ens", "zp_scatter", "n_comp"), "time", "mag", "mag_err", "zp_ens", "zp_scatter")


@query("agg01_many_lightcurves", f""", {COMPS}, good AS (SELECT * FROM meas WHERE band = 'click' AND flag <= 0),
    zp AS (SELECT frame, avg(z) AS zp_ens, count(*) AS n_comp FROM (SELECT g.frame, c.v_jkc_mag - g.m_inst AS z FROM good g JOIN comps c USING (source_id)) GROUP BY frame HAVING count(*) >= 3),
    lc AS (SELECT t.source_id, t.frame, t.m_inst + zp_ens AS mag, n_comp FROM good t JOIN zp USING (frame) WHERE t.source_id NOT IN (SELECT source_id FROM comps))
    SELECT source_id, frame, round(mag, 5) AS mag, round(mag - median(mag) OVER (PARTITION BY source_id), 5) + 0.0 AS dmag, n_comp FROM lc""", "meas stars")  # fmt: skip
def agg01_many(s, d):
    """Every star that is no comparison is a target."""
    comps, m = comparisons(s, d), meas(s, d)
    targets = m.select("source_id").join(comps, "source_id", "left_anti")
    out = ensemble.lightcurves(m, targets, comps, band="click", time_col="time")
    return rounded(out.select("source_id", "frame", "mag", "dmag", "n_comp"), "mag", "dmag", digits=5)


@query("agg02_dmag", lc_sql("SELECT frame, round(dmag, 6) + 0.0 AS dmag FROM lc"), "meas stars")
def agg02(s, d):
    return rounded(lightcurve(s, d).select("frame", "dmag"), "dmag")


@query("agg02_summary", lc_sql("SELECT 7 AS target_id, 'click' AS band, (SELECT count(*) FROM comps) AS n_comp_pool, round(stddev_pop(mag), 6) AS scatter FROM lc"), "meas stars")
def agg02_summary(s, d):
    return rounded(ensemble.summary(lightcurve(s, d), 7, "click", comparisons(s, d)), "scatter")


LOO = f"""{COMPS}, good AS (SELECT m.*, c.v_jkc_mag - m.m_inst AS z FROM meas m JOIN comps c USING (source_id) WHERE band = 'click' AND flag <= 0),
    curve AS (SELECT a.source_id, a.frame, a.m_inst + avg(b.z) AS mag, avg(b.z) AS zp_ens, coalesce(stddev_samp(b.z), 0) AS zp_scatter, count(*) AS n_comp
    FROM good a JOIN good b ON a.frame = b.frame AND a.source_id <> b.source_id GROUP BY a.source_id, a.frame, a.m_inst HAVING count(*) >= 3),
    curves AS (SELECT *, mag - median(mag) OVER (PARTITION BY source_id) AS dmag FROM curve)"""


def curves(s, d) -> DataFrame:
    return ensemble.comparison_curves(meas(s, d), comparisons(s, d), band="click", time_col="time")


@query("agg09_leave_one_out", joined("SELECT source_id, frame, round(mag, 5) AS mag, round(zp_ens, 5) AS zp_ens, round(zp_scatter, 5) AS zp_scatter, n_comp, round(dmag, 5) + 0.0 AS dmag FROM curves", LOO), "meas stars")
def agg09(s, d):
    return rounded(curves(s, d).select("source_id", "frame", "mag", "zp_ens", "zp_scatter", "n_comp", "dmag"), "mag", "zp_ens", "zp_scatter", "dmag", digits=5)


RANK = "SELECT source_id, count(*) AS n, coalesce(stddev_pop(dmag), 0) AS scatter FROM curves GROUP BY source_id"


@query("agg19_scatter_rank", joined(f'SELECT source_id, n, round(scatter, 5) AS scatter, scatter > 0.05 AS "check" FROM ({RANK})', LOO), "meas stars")
def agg19(s, d):
    return rounded(ensemble.scatter_ranking(curves(s, d)), "scatter", digits=5)


@query("agg20_noise_floor", joined(f"SELECT round(min(CASE WHEN scatter > 1e-9 THEN scatter END), 5) AS floor FROM ({RANK})", LOO), "meas stars")
def agg20(s, d):
    return rounded(ensemble.noise_floor(ensemble.scatter_ranking(curves(s, d))), "floor", digits=5)


# ------------------------------------------------------------------ depth and quality

@query("agg03_depth_by_group", "SELECT model, count(*) AS n, round(median(v), 6) AS v_lim, round(stddev_pop(v), 6) AS v_lim_std FROM (SELECT model, v_lim_5sigma + 1.25 * log10(900.0 / total_exptime) AS v FROM frames WHERE rms < 0.06) GROUP BY model", "frames")
def agg03(s, d):
    return rounded(depth.detection_limit(frames(s, d)), "v_lim", "v_lim_std")


@query("agg04_depth_grid", "SELECT model, exptime, count(*) AS n, round(median(v), 5) AS v_lim, round(stddev_pop(v), 5) AS v_lim_std FROM (SELECT model, exptime, v_lim_5sigma + 1.25 * log10(exptime / total_exptime) AS v FROM frames, (SELECT unnest([60.0, 900.0, 3600.0, 14400.0, 57600.0])::DOUBLE AS exptime) WHERE rms < 0.06) GROUP BY model, exptime", "frames")
def agg04(s, d):
    return rounded(depth.limit_vs_exptime(frames(s, d)), "v_lim", "v_lim_std", digits=5)


@query("agg06_rms_percentiles", "SELECT round(quantile_cont(rms, 0.1), 6) AS p10, round(quantile_cont(rms, 0.5), 6) AS p50, round(quantile_cont(rms, 0.9), 6) AS p90, count(*) FILTER (rms < 0.06) AS n_photometric, count(*) AS n FROM frames", "frames")
def agg06(s, d):
    return rounded(depth.rms_percentiles(frames(s, d)), "p10", "p50", "p90")


@query("agg07_saturation", "SELECT frame, round(max(CASE WHEN max_pix_value >= 62258.25 THEN v_jkc_mag END), 6) AS v_sat FROM obs GROUP BY frame", "obs")
def agg07(s, d):
    return rounded(calibrate.saturation_mag(obs(s, d)), "v_sat")


@query("agg08_aperture_noise", "SELECT frame, round(median(sqrt(flux)), 6) AS sigma_aper FROM obs WHERE band = 'N' GROUP BY frame", "obs")
def agg08(s, d):
    return rounded(depth.aperture_noise(obs(s, d).withColumn("fluxerr", F.sqrt("flux")), band="N"), "sigma_aper")


@query("agg10_counts", "SELECT frame, count(*) AS n FROM meas GROUP BY frame", "meas")
def agg10(s, d):
    return ensemble.sources_per_frame(meas(s, d))


@query("agg11_distinct_ids", "SELECT DISTINCT source_id FROM meas", "meas")
def agg11(s, d):
    return ensemble.measured_ids(meas(s, d))


@query("agg17_histogram", """SELECT least(floor((rms - a) / ((b - a) / 40)), 39)::BIGINT AS bin, count(*) AS n FROM (SELECT round(rms, 9) AS rms FROM frames), (SELECT min(round(rms, 9)) - 0.00001 AS a, max(round(rms, 9)) + 0.0000137 AS b FROM frames) GROUP BY 1""", "frames")
def agg17(s, d):
    f = frames(s, d).select(F.round("rms", 9).alias("rms"))
    low, high = f.agg(F.min("rms") - 0.00001, F.max("rms") + 0.0000137).first()
    return period.histogram(f, "rms", 40, bounds=(low, high)).select(F.col("bin").cast("long").alias("bin"), "n")


POINTS = """p0 AS (SELECT frame || band AS frame, v_jkc_mag - (-2.5 * log10(flux)) AS r, bp_rp AS colour, snr FROM obs WHERE v_jkc_mag BETWEEN 10 AND 14),
    p AS (SELECT *, colour - median(colour) OVER (PARTITION BY frame) AS x, median(colour) OVER (PARTITION BY frame) AS colour0, true AS u0 FROM p0)"""


def fit_sql(colour: bool, out: str) -> str:
    parts, last = [POINTS], "p"
    for i in range(3):
        k = f"CASE WHEN regr_sxx(r, x) FILTER (u{i}) > 0 THEN regr_slope(r, x) FILTER (u{i}) END" if colour else "0.0"
        zp = f"regr_intercept(r, x) FILTER (u{i})" if colour else f"avg(r) FILTER (u{i})"
        parts.append(f"f{i} AS (SELECT frame, {k} AS k{i}, {zp} AS zp{i}, regr_sxx(r, x) FILTER (u{i}) AS sxx{i}, avg(x) FILTER (u{i}) AS mx{i}, count(*) FILTER (u{i}) AS n{i} FROM {last} GROUP BY frame)")
        resid = f"r - zp{i} - k{i} * x" if colour else f"r - zp{i}"
        parts.append(f"r{i} AS (SELECT l.*, k{i}, zp{i}, sxx{i}, mx{i}, n{i}, {resid} AS e{i} FROM {last} l JOIN f{i} USING (frame))")
        parts.append(f"g{i} AS (SELECT *, abs(e{i}) < 3 * stddev_pop(CASE WHEN u{i} THEN e{i} END) OVER (PARTITION BY frame) AS u{i + 1} FROM r{i})")
        last = f"g{i}"
    parts.append("""fit AS (SELECT frame, any_value(zp2) AS zeropoint, any_value(k2) AS colour_term, any_value(colour0) AS colour0, count(*) FILTER (u3) AS n_stars, stddev_pop(e2) FILTER (u3) AS rms, any_value(n2) AS n_fit,
        any_value(sxx2) AS sxx, any_value(mx2) AS mx, sum(e2 * e2) FILTER (u2) / nullif(any_value(n2) - 2, 0) AS s2, sum(pow(e2 * snr / 1.0857, 2)) FILTER (u3) AS chi2, stddev_pop(r) FILTER (u3) AS spread FROM g2 GROUP BY frame)""")
    return joined(out, ", ".join(parts))


def fit_input(s, d) -> DataFrame:
    return obs(s, d).withColumn("frame", F.concat("frame", "band")).withColumn("band", F.lit("G")).withColumn("phot_variable_flag", F.lit("NOT_AVAILABLE"))


FIT_OUT = "SELECT frame, round(zeropoint, 5) AS zeropoint, round(sqrt(s2 * (1.0 / n_fit + mx * mx / sxx)), 5) AS zeropoint_err, round(colour_term, 5) + 0.0 AS colour_term, round(sqrt(s2 / sxx), 5) AS colour_term_err, round(colour0, 5) AS colour0, n_stars, round(rms, 5) AS rms FROM fit WHERE n_fit > 2 AND n_stars > 0"


@query("fit01_zeropoint", fit_sql(True, FIT_OUT), "obs")
def fit01(s, d):
    return rounded(calibrate.fit_zeropoint(fit_input(s, d)).select("frame", "zeropoint", "zeropoint_err", "colour_term", "colour_term_err", "colour0", "n_stars", "rms"), "zeropoint", "zeropoint_err", "colour_term", "colour_term_err", "colour0", "rms", digits=5)


@query("fit02_clipped_mean", fit_sql(False, "SELECT frame, round(zeropoint, 4) AS zeropoint, round(spread / sqrt(n_stars), 4) AS zeropoint_err, n_stars, round(rms, 4) AS rms FROM fit WHERE n_stars > 0"), "obs")
def fit02(s, d):
    return rounded(calibrate.fit_zeropoint(fit_input(s, d).drop("bp_rp")).select("frame", "zeropoint", "zeropoint_err", "n_stars", "rms"), "zeropoint", "zeropoint_err", "rms", digits=4)


@query("fit03_chi2", fit_sql(True, "SELECT frame, round(chi2 / greatest(n_stars - 2, 1), 3) AS chi2_red FROM fit WHERE n_fit > 2 AND n_stars > 0"), "obs")
def fit03(s, d):
    return rounded(calibrate.fit_zeropoint(fit_input(s, d)).select("frame", "chi2_red"), "chi2_red", digits=3)


@query("fit05_depth_model", joined("""SELECT unit, round(my - b * m1 - c * m2 - e * m3, 4) AS a, round(b, 4) + 0.0 AS b, round(c, 4) + 0.0 AS c, round(e, 4) + 0.0 AS d, round(sqrt(greatest(vy - b * c1 - c * c2 - e * c3, 0)), 4) AS rms, n
    FROM (SELECT *, (c1 * (v2 * v3 - c23 * c23) - c12 * (c2 * v3 - c23 * c3) + c13 * (c2 * c23 - v2 * c3)) / det AS b, (v1 * (c2 * v3 - c23 * c3) - c1 * (c12 * v3 - c23 * c13) + c13 * (c12 * c3 - c2 * c13)) / det AS c,
        (v1 * (v2 * c3 - c2 * c23) - c12 * (c12 * c3 - c2 * c13) + c1 * (c12 * c23 - v2 * c13)) / det AS e FROM s)""",
    """s AS (SELECT *, v1 * (v2 * v3 - c23 * c23) - c12 * (c12 * v3 - c23 * c13) + c13 * (c12 * c23 - v2 * c13) AS det FROM (SELECT unit, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, var_pop(x3) AS v3, var_pop(y) AS vy,
        covar_pop(x1, x2) AS c12, covar_pop(x1, x3) AS c13, covar_pop(x2, x3) AS c23, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x3, y) AS c3
        FROM (SELECT unit, log10(total_exptime) AS x1, sky_sb AS x2, fwhm_G AS x3, v_lim_5sigma AS y FROM frames WHERE rms < 0.06 AND total_exptime > 0) GROUP BY unit))"""), "frames")  # fmt: skip
def fit05(s, d):
    return rounded(depth.fit_depth_model(frames(s, d), keys=("unit",)), "a", "b", "c", "d", "rms", digits=4)


@query("fit06_trend", "SELECT unit, round(regr_slope(v_lim_5sigma, sky_sb), 6) + 0.0 AS slope, round(regr_intercept(v_lim_5sigma, sky_sb), 6) AS intercept, count(*) AS n FROM frames GROUP BY unit HAVING count(*) > 5", "frames")
def fit06(s, d):
    return rounded(diagnostics.trend(frames(s, d), "sky_sb", "v_lim_5sigma", ("unit",)), "slope", "intercept")


# ------------------------------------------------------------------ series

@query("win02_running_median")
def win02(s, d):
    return rounded(period.running_median(meas(s, d), "time", "m_inst", ("band",), ("source_id",)), "x", "y")


ORACLE["win02_running_median"] = f"""WITH meas AS ({VIEWS['meas']}), i AS (SELECT band, time, m_inst, count(*) OVER (PARTITION BY band) AS c, row_number() OVER (PARTITION BY band ORDER BY time, m_inst, source_id) - 1 AS i FROM meas),
    k AS (SELECT *, greatest(c // 20, 4) AS k FROM i WHERE c > 20), t AS (SELECT *, CASE WHEN i < (c % k) * (c // k + 1) THEN i // (c // k + 1) ELSE (c % k) + (i - (c % k) * (c // k + 1)) // (c // k) END + 1 AS tile FROM k)
    SELECT band, tile, round(median(time), 6) AS x, round(median(m_inst), 6) AS y, count(*) AS n FROM t GROUP BY band, tile"""


@query("win02_running_median_whole", "WITH t AS (SELECT l_quantity, l_extendedprice, row_number() OVER (ORDER BY l_quantity, l_extendedprice, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER () AS c FROM lineitem), k AS (SELECT *, greatest(c // 20, 4) AS k FROM t) SELECT CASE WHEN i < (c % k) * (c // k + 1) THEN i // (c // k + 1) ELSE (c % k) + (i - (c % k) * (c // k + 1)) // (c // k) END + 1 AS tile, median(l_quantity)::DOUBLE AS x, round(median(l_extendedprice), 4) AS y, count(*) AS n FROM k GROUP BY 1")
def win02_whole(s, d):
    """One series, its places by sorted ranges."""
    rows = read(s, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    return rounded(period.running_median(rows, "l_quantity", "l_extendedprice", order=("l_orderkey", "l_linenumber")), "y", digits=4)


@query("win05_relative_time", "SELECT source_id, frame, band, round(time - (SELECT floor(min(time)) FROM meas), 6) AS rel_time FROM meas", "meas")
def win05(s, d):
    return rounded(period.relative_time(meas(s, d)).select("source_id", "frame", "band", "rel_time"), "rel_time")


PG = """pts AS (SELECT time - (SELECT min(time) FROM lc) AS t, dmag AS y FROM lc), span AS (SELECT max(t) AS base, count(*) AS n FROM pts),
    grid AS (SELECT 1.0 / base + unnest(range(0, 1 + round((1.0 / 0.5 - 1.0 / base) * base * 10)::BIGINT)) / (base * 10) AS frequency FROM span),
    m AS (SELECT frequency, avg(cos(a)) AS c, avg(sin(a)) AS s, avg(y) AS y, avg(y * y) AS yy, avg(y * cos(a)) AS yc, avg(y * sin(a)) AS ys, avg(cos(a) * cos(a)) AS cc, avg(sin(a) * sin(a)) AS ss, avg(cos(a) * sin(a)) AS cs
        FROM (SELECT frequency, y, 2 * pi() * frequency * t AS a FROM grid, pts) GROUP BY frequency),
    q AS (SELECT frequency, yy - y * y AS yy, yc - y * c AS yc, ys - y * s AS ys, cc - c * c AS cc, ss - s * s AS ss, cs - c * s AS cs FROM m)"""


@query("fit07_periodogram", lc_sql("SELECT round(frequency, 6) AS frequency, round((ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)), 5) AS power FROM q WHERE yy * (cc * ss - cs * cs) > 1e-9").replace(" SELECT round(frequency", f", {PG} SELECT round(frequency"), "meas stars")
def fit07(s, d):
    pg = period.periodogram(lightcurve(s, d), min_period=0.5)
    return rounded(rounded(pg.where("power IS NOT NULL").select("frequency", "power"), "frequency"), "power", digits=5)


@query("dia19_phase_bins", lc_sql("SELECT (bin + 0.5) / 25 AS phase, round(avg(dmag), 6) + 0.0 AS mean, count(*) AS n FROM (SELECT dmag, floor((time / 3.7 - floor(time / 3.7)) * 25) AS bin FROM lc) GROUP BY bin"), "meas stars")
def dia19(s, d):
    return rounded(period.phase_bins(period.fold(lightcurve(s, d), 3.7, 0.0)), "mean")


# ------------------------------------------------------------------ joins on the sky and in pixels

def sides(s, d):
    p = sky_points(s, d)
    det = p.where("vec_id % 2 = 0").select(F.col("vec_id").alias("det_id"), "ra", "dec")
    cat = p.where("vec_id % 2 = 1").select(F.col("vec_id").alias("source_id"), "ra", "dec", F.when(F.col("label") != 3, F.col("label") + 10.0).alias("v_jkc_mag"))
    return det, cat


XM = f"""near AS (SELECT det_id, arg_min(struct_pack(sep, id, v), struct_pack(sep, id)) AS b FROM (SELECT d.vec_id AS det_id, c.vec_id AS id, CASE WHEN c.label <> 3 THEN c.label + 10.0 END AS v,
    {SEP.format(a0="d.ra", d0="d.dec", a1="c.ra", d1="c.dec")} * 3600 AS sep FROM (SELECT * FROM sky WHERE vec_id % 2 = 0) d, (SELECT * FROM sky WHERE vec_id % 2 = 1) c) GROUP BY det_id)"""


@query("join01_crossmatch", joined("SELECT det_id, round(b.sep, 3) AS sep_arcsec, coalesce(CASE WHEN b.sep < 7200 THEN b.id END, -1) AS source_id, CASE WHEN b.sep < 7200 THEN b.v END AS v_jkc_mag FROM near", XM), "sky")
def join01(s, d):
    det, cat = sides(s, d)
    return rounded(match.crossmatch(det, cat, "det_id", 7200.0, ("source_id", "v_jkc_mag"), radii_deg=(4.0, 16.0)).select("det_id", "sep_arcsec", F.coalesce("source_id", F.lit(-1)).alias("source_id"), "v_jkc_mag"), "sep_arcsec", digits=3)


@query("agg05_match_quality", joined("SELECT round(quantile_cont(b.sep, 0.5), 3) AS sep_median, round(quantile_cont(b.sep, 0.9), 3) AS sep_p90, round(avg((b.sep < 7200)::INT), 6) AS matched_frac, count(*) AS n FROM near", XM), "sky")
def agg05(s, d):
    det, cat = sides(s, d)
    q = match.match_quality(match.crossmatch(det, cat, "det_id", 7200.0, ("source_id",), radii_deg=(4.0, 16.0)), 7200.0)
    return rounded(rounded(q, "sep_median", "sep_p90", digits=3), "matched_frac")


def pixels(s, d):
    det, cat = sides(s, d)
    return det.select("det_id", F.col("ra").alias("x"), F.col("dec").alias("y")), cat.select(F.col("source_id").alias("cat_id"), F.col("ra").alias("cx"), F.col("dec").alias("cy"))


@query("join02_pairs", """, pairs AS (SELECT d.vec_id AS det_id, c.vec_id AS cat_id, sqrt(pow(d.ra - c.ra, 2) + pow(d.dec - c.dec, 2)) AS dist FROM sky d JOIN sky c ON d.vec_id % 2 = 0 AND c.vec_id % 2 = 1),
    one AS (SELECT * FROM pairs WHERE dist <= 5 QUALIFY row_number() OVER (PARTITION BY cat_id ORDER BY dist, det_id) = 1)
    SELECT det_id, cat_id, round(dist, 6) AS dist FROM one QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY dist, cat_id) = 1""", "sky")  # fmt: skip
def join02(s, d):
    return rounded(match.pair_up(*pixels(s, d), 5.0), "dist")


@query("join03_offset_vote", joined("""SELECT votes::BIGINT AS votes, round(dx, 6) AS dx, round(dy, 6) AS dy FROM (SELECT count(*) AS votes, avg(ox) AS dx, avg(oy) AS dy, ix, iy
    FROM (SELECT *, floor((ox + 160) / 32) AS ix, floor((oy + 160) / 32) AS iy FROM (SELECT a.ra - b.ra AS ox, a.dec - b.dec AS oy FROM side a, side b WHERE a.p = 0 AND b.p = 1) WHERE abs(ox) <= 160 AND abs(oy) <= 160) GROUP BY ix, iy) ORDER BY votes DESC, ix, iy LIMIT 1""",
    "side AS (SELECT * FROM (SELECT vec_id % 2 AS p, ra, dec, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY coalesce(label, 99), vec_id) AS r FROM sky) WHERE r <= 250)"), "sky")
def join03(s, d):
    """The 250 brightest rows of either side vote; the label stands in for the magnitude."""
    p = sky_points(s, d).withColumn("side", F.col("vec_id") % 2).withColumn("mag", F.coalesce("label", F.lit(99)))
    top = solve.brightest(p, 250, ("side",), "mag", "vec_id")
    det, cat = top.where("side = 0").select(F.col("ra").alias("x"), F.col("dec").alias("y")), top.where("side = 1").select(F.col("ra").alias("px"), F.col("dec").alias("py"))
    return rounded(match.offset_vote(det, cat, 160.0), "dx", "dy")


@query("join11_all_nn", "SELECT a.vec_id AS det_id, round(min(sqrt(pow(a.ra - b.ra, 2) + pow(a.dec - b.dec, 2))) FILTER (sqrt(pow(a.ra - b.ra, 2) + pow(a.dec - b.dec, 2)) <= 20), 6) AS nn_dist FROM sky a JOIN sky b ON a.vec_id <> b.vec_id GROUP BY 1", "sky")
def join11_all(s, d):
    points = sky_points(s, d).select(F.col("vec_id").alias("det_id"), F.col("ra").alias("x"), F.col("dec").alias("y"))
    return rounded(match.nearest_neighbour(points, 20.0, "det_id"), "nn_dist")


@query("join04_lookup", "SELECT l_orderkey, l_linenumber, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10")
def join04(s, d):
    photometry = read(s, d, "part").select(F.col("p_partkey").alias("source_id"), "p_brand", "p_size", F.col("p_size").alias("v_jkc_mag"))
    return catalogue.with_photometry(read(s, d, "lineitem").withColumnRenamed("l_partkey", "source_id"), photometry, 10).select("l_orderkey", "l_linenumber", "p_brand", "p_size")


@query("join06_dict", joined("SELECT m.source_id, m.frame, round(c.v_jkc_mag, 6) AS cat FROM meas m JOIN comps c USING (source_id)", COMPS), "meas stars")
def join06(s, d):
    return rounded(meas(s, d).join(ensemble.reference_mags(comparisons(s, d), "v_jkc_mag"), "source_id").select("source_id", "frame", "cat"), "cat")


@query("join07_frame_join", "SELECT m.frame, count(*) AS n, round(avg(zp), 6) AS zp FROM meas m JOIN (SELECT frame, avg(m_inst) AS zp FROM meas GROUP BY frame) f USING (frame) GROUP BY m.frame", "meas")
def join07(s, d):
    m = meas(s, d)
    quality = m.groupBy("frame").agg(F.avg("m_inst").alias("zp"))
    return rounded(ensemble.with_frames(m, quality, "zp").groupBy("frame").agg(F.count("*").alias("n"), F.avg("zp").alias("zp")), "zp")


_datasets: dict[tuple[str, str], str] = {}


def dataset(s, d, own: bool = False) -> str:
    """The field as a dataset, written once a session; ``own``: a copy that the caller may change."""
    key = (s.sparkContext.applicationId, d)
    if own or key not in _datasets:
        path = fresh_path(s, "dataset")
        catalogue.write_dataset(catalogue_rows(field_points(s, d)), path)
        if own:
            return path
        _datasets[key] = path
    return _datasets[key]


@query("cat05_cone", f"SELECT vec_id, round(sep, 6) AS sep FROM (SELECT vec_id, label, {SEP.format(a0=120.0, d0=10.0, a1='ra', d1='dec')} AS sep FROM field) WHERE sep <= 3 AND label < 8", "sky field")
def cat05(s, d):
    """A cone of the partitioned dataset, which the session's first query of it writes."""
    p = catalogue.cone(s, dataset(s, d), 120.0, 10.0, 3.0, vmag_limit=8.0)
    return rounded(p.select(vec_of().alias("vec_id"), sky.separation_deg(120.0, 10.0, "ra", "dec").alias("sep")), "sep")


# ------------------------------------------------------------------ sets, sorts, limits

@query("set01_union", "SELECT s_suppkey AS key, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def set01(s, d):
    a = read(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return catalogue.stacked([a, read(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))])


@query("set02_unique", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def set02(s, d):
    return catalogue.unique(read(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey")


@query("srt05_top_n", "SELECT band, source_id, frame, round(flux, 4) AS flux FROM meas QUALIFY row_number() OVER (PARTITION BY band ORDER BY round(flux, 4) DESC, source_id, frame) <= 20", "meas")
def srt05(s, d):
    m = meas(s, d).withColumn("flux", F.round("flux", 4))
    return solve.brightest(m, 20, ("band",), F.desc("flux"), "source_id", "frame").select("band", "source_id", "frame", "flux")


@query("srt07_worst", joined(f"SELECT source_id, round(scatter, 5) AS scatter FROM ({RANK}) ORDER BY round(scatter, 5) DESC, source_id LIMIT 16", LOO), "meas stars")
def srt07(s, d):
    return rounded(ensemble.scatter_ranking(curves(s, d)), "scatter", digits=5).orderBy(F.desc("scatter"), "source_id").limit(16).select("source_id", "scatter")


@query("srt08_strided", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, ceil((SELECT count(*) FROM embeddings) / 60.0)::BIGINT AS k FROM embeddings) WHERE i % k = 0")
def srt08(s, d):
    return solve.strided(read(s, d, "embeddings").select("vec_id"), "vec_id", 60)



# ------------------------------------------------------------------ growth curves, widths, reports

STARS_SQL = """star AS (SELECT l_returnflag AS band, l_suppkey AS star, l_linenumber AS radius, sum(l_quantity) * l_linenumber AS flux FROM lineitem GROUP BY 1, 2, 3),
    cog AS (SELECT band, radius, median(frac) AS flux_frac, stddev_pop(frac) AS flux_frac_std, count(*) AS n_stars FROM (SELECT *, flux / arg_max(flux, radius) OVER (PARTITION BY band, star) AS frac FROM star) GROUP BY band, radius)"""


def growth_rows(s, d) -> DataFrame:
    rows = read(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("band"), F.col("l_suppkey").alias("star"), F.col("l_linenumber").alias("radius")).agg((F.sum("l_quantity") * F.first("l_linenumber")).alias("flux"))
    return growth.median_growth(rows, ("band",))


@query("agg13_curve_of_growth", f"WITH {STARS_SQL} SELECT band, radius, round(flux_frac, 6) AS flux_frac, round(flux_frac_std, 6) AS flux_frac_std, n_stars FROM cog")
def agg13(s, d):
    return rounded(growth_rows(s, d), "flux_frac", "flux_frac_std")


@query("fn19_aperture", f"""WITH {STARS_SQL}, seg AS (SELECT band, radius, flux_frac AS x1, lag(flux_frac) OVER w AS x0, radius AS y1, lag(radius) OVER w AS y0 FROM cog WINDOW w AS (PARTITION BY band ORDER BY radius)),
    hit AS (SELECT band, radius, CASE WHEN x0 IS NULL AND x1 >= 0.5 THEN y1 WHEN x0 < 0.5 AND x1 >= 0.5 THEN y0 + (0.5 - x0) * (y1 - y0) / (x1 - x0) END AS v, y1 FROM seg)
    SELECT band, round(coalesce(arg_min(v, radius) FILTER (v IS NOT NULL), arg_max(y1, radius))::DOUBLE, 6) AS aperture FROM hit GROUP BY band""")  # fmt: skip
def fn19(s, d):
    return rounded(growth.aperture_for_enclosed_flux(growth_rows(s, d), 0.5, ("band",)), "aperture")


@query("fn20_aperture_correction", f"WITH {STARS_SQL} SELECT a.band, round(2.5 * log10((a.flux_frac + b.flux_frac) / 2), 6) + 0.0 AS correction FROM cog a JOIN cog b ON a.band = b.band AND a.radius = 3 AND b.radius = 4")
def fn20(s, d):
    return rounded(growth.aperture_correction(growth_rows(s, d), 3.5, ("band",)), "correction")


@query("flt12_point_like", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, median(CASE WHEN l_extendedprice > 50000 THEN l_quantity END) OVER (PARTITION BY l_returnflag) AS r FROM lineitem) WHERE r IS NULL OR l_quantity <= 0.5 * r")
def flt12(s, d):
    rows = read(s, d, "lineitem").withColumn("a", F.col("l_quantity"))
    return growth.point_like(rows, F.col("l_extendedprice") > 50000, 0.5, ("l_returnflag",)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("flt11_bright_round", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice / 1000 > 50 AND l_quantity / 50 > 0.7 AND (l_linenumber & 2) = 0")
def flt11(s, d):
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("snr"), F.lit(50.0).alias("a"), F.col("l_quantity").alias("b"), F.col("l_linenumber").alias("flag"))
    return growth.bright_round(rows, 50.0, 2).select("l_orderkey", "l_linenumber")


@query("agg14_median_fwhm", "SELECT l_returnflag AS band, round(2 * median(l_quantity / 20), 6) AS fwhm FROM lineitem GROUP BY 1")
def agg14(s, d):
    return rounded(growth.median_fwhm(read(s, d, "lineitem").select(F.col("l_returnflag").alias("band"), (F.col("l_quantity") / 20).alias("r_half")), ("band",)), "fwhm")


@query("agg16_stack_report", """SELECT o_orderpriority AS unit, count(*) AS n_in, count(*) FILTER (o_orderstatus <> 'F') AS n_ok, count(*) FILTER (o_orderstatus = 'F') AS n_bad, round(median(o_totalprice) FILTER (o_orderstatus <> 'F'), 4) AS resid_median_px,
    round(max(o_custkey) FILTER (o_orderstatus <> 'F') - min(o_custkey) FILTER (o_orderstatus <> 'F'), 4)::DOUBLE AS rot_span_deg, round(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 2) AS total_exptime,
    coalesce(string_agg(DISTINCT o_orderstatus || (o_custkey % 3)::VARCHAR, ',' ORDER BY o_orderstatus || (o_custkey % 3)::VARCHAR) FILTER (o_orderstatus = 'F'), '') AS reasons FROM orders GROUP BY 1""")  # fmt: skip
def agg16(s, d):
    rows = read(s, d, "orders").select(F.col("o_orderpriority").alias("unit"), (F.col("o_orderstatus") != "F").alias("ok"), F.col("o_totalprice").alias("resid"), F.col("o_custkey").cast("double").alias("rotation"), F.col("o_totalprice").alias("exptime"), F.concat("o_orderstatus", (F.col("o_custkey") % 3).cast("string")).alias("reason"))
    out = growth.stack_report(rows, ("unit",)).withColumn("reasons", F.array_join("reasons", ","))
    return rounded(rounded(out, "resid_median_px", "rot_span_deg", digits=4), "total_exptime", digits=2)


@query("agg21_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def agg21(s, d):
    return stages.status_counts(read(s, d, "orders").withColumnRenamed("o_orderstatus", "status"))


@query("agg22_host_flux", """SELECT frame, CASE WHEN count(f) >= 4 THEN round(median(f), 6) ELSE 0 END AS host, CASE WHEN count(f) > 1 THEN round(stddev_pop(f), 6) END AS host_std, count(f) AS n
    FROM (SELECT frame, CASE WHEN flag = 0 THEN flux END AS f FROM meas) GROUP BY frame""", "meas")  # fmt: skip
def agg22(s, d):
    return rounded(growth.host_flux(meas(s, d).select("frame", "flux", (F.col("flag") == 0).alias("clean"))), "host", "host_std")


@query("win01_first_row", "SELECT source_id, frame, band, round(m_inst, 6) AS m_inst FROM meas QUALIFY row_number() OVER (PARTITION BY source_id, band ORDER BY time, m_inst, frame) = 1", "meas")
def win01(s, d):
    rows = ensemble.first_rows(meas(s, d), ("source_id", "band"), "time", "m_inst", "frame")
    return rounded(rows.select("source_id", "frame", "band", "m_inst"), "m_inst")


@query("win03_nearest_target", "SELECT source_id, sep_target_arcmin FROM stars ORDER BY sep_target_arcmin, source_id LIMIT 1", "stars")
def win03(s, d):
    return ensemble.nearest(stars(s, d)).select("source_id", "sep_target_arcmin")


@query("win06_unit_series", "SELECT unit, round(rms, 6) AS value, date_obs AS time, (epoch_us(date_obs) - min(epoch_us(date_obs)) OVER (PARTITION BY unit))::BIGINT AS since_us FROM frames", "frames")
def win06(s, d):
    f = frames(s, d).withColumn("t", F.unix_micros(F.col("date_obs").cast("timestamp")))
    out = diagnostics.series_by_unit(f, "rms", "t")
    return rounded(out.select("unit", "value", F.timestamp_micros("time").cast("timestamp_ntz").alias("time"), F.col("since").alias("since_us")), "value")


@query("srt01_all_frames_sorted", "SELECT unit, date_obs, frame FROM frames ORDER BY unit, date_obs, frame", "frames")
def srt01_all(s, d):
    return stages.sorted_frames(frames(s, d).select("unit", "date_obs", "frame"), "frame")


@query("srt06_brightness_rank", "SELECT source_id, row_number() OVER (ORDER BY v_jkc_mag ASC NULLS LAST, source_id)::INT AS rank FROM stars", "stars")
def srt06(s, d):
    return solve.brightness_rank(stars(s, d)).select("source_id", "rank")


@query("set03_upsert", """SELECT vec_id, CASE WHEN label < 3 THEN label + 100 ELSE label END::DOUBLE AS v FROM field UNION ALL SELECT vec_id + 1000000, label::DOUBLE FROM field WHERE label = 3""", "sky field")
def set03(s, d):
    """The dataset after new rows for stored ids (label below 3) and rows with new ids (label 3)."""
    path, p = dataset(s, d, own=True), field_points(s, d)
    new = catalogue_rows(p.where("label < 3"), v="label + 100").unionByName(catalogue_rows(p.where("label = 3"), "vec_id + 1000000"))
    incoming = fresh_path(s, "incoming")
    new.write.parquet(incoming)
    catalogue.upsert(s, s.read.parquet(incoming), path)
    return catalogue.read(s, path).select(vec_of().alias("vec_id"), F.col("v_jkc_mag").cast("double").alias("v"))


def archive_tables(s, d) -> tuple[DataFrame, DataFrame]:
    """Sources with G magnitudes, and synthetic photometry of those with an even label."""
    p = field_points(s, d)
    rows = catalogue_rows(p).join(catalogue_rows(p, v="label + 10").select("source_id", F.col("v_jkc_mag").alias("phot_g_mean_mag")), "source_id").drop("v_jkc_mag")
    return rows, catalogue_rows(p.where("label % 2 = 0"), v="label + 11").select("source_id", "v_jkc_mag")


@query("src12_remote_cone", f"SELECT vec_id, label + 10.0::DOUBLE AS g, CASE WHEN label % 2 = 0 THEN label + 11.0::DOUBLE END AS v FROM field WHERE {SEP.format(a0=120.0, d0=10.0, a1='ra', d1='dec')} <= 3 AND label + 10 < 17", "sky field")
def src12(s, d):
    """The archive's cone query over local tables."""
    out = catalogue.remote_cone(*archive_tables(s, d), 120.0, 10.0, 3.0, 17.0)
    return out.select(vec_of().alias("vec_id"), F.col("phot_g_mean_mag").cast("double").alias("g"), F.col("v_jkc_mag").cast("double").alias("v"))


@query("src13_region", f"SELECT vec_id, label + 11.0::DOUBLE AS v FROM field WHERE {SEP.format(a0=121.0, d0=9.0, a1='ra', d1='dec')} <= 4 AND label % 2 = 0 AND label + 11 < 17.5", "sky field")
def src13(s, d):
    out = catalogue.region(*archive_tables(s, d), 121.0, 9.0, 4.0)
    return out.select(vec_of().alias("vec_id"), F.col("v_jkc_mag").cast("double").alias("v"))


TILES = " OR ".join(f"{SEP.format(a0=a, d0=b, a1='ra', d1='dec')} <= {1.5 / 2 * 2**0.5 + 0.1}" for a, b in sky.tile_centres(120.0, 10.0, 1.5, 2))


@query("cat01_mosaic", f"SELECT vec_id FROM field WHERE {TILES}", "sky field")
def cat01(s, d):
    """Four overlapping tiles, each source once."""
    path = dataset(s, d)
    fetch = lambda ra, dec, r: catalogue.cone(s, path, ra, dec, r)
    return catalogue.mosaic(fetch, 120.0, 10.0, 1.5, 2).select(vec_of().alias("vec_id"))


@query("cat03_epoch_cone", f"""SELECT vec_id, round(pm - 360 * floor(pm / 360), 6) AS ra, round(dec - 50 * 10 / 3.6e6, 6) AS dec FROM (SELECT vec_id, dec, ra + 100 * 10 / 3.6e6 / greatest(cos(radians(dec)), 1e-8) AS pm FROM field WHERE {SEP.format(a0=120.0, d0=10.0, a1='ra', d1='dec')} <= 3)""", "sky field")
def cat03(s, d):
    """A cone of a dataset with proper motions, at another epoch."""
    path = fresh_path(s, "moving")
    catalogue.write_dataset(catalogue_rows(field_points(s, d)).withColumns({"pmra": F.lit(100.0), "pmdec": F.lit(-50.0)}), path)
    out = catalogue.cone(s, path, 120.0, 10.0, 3.0, epoch=2026.0)
    return rounded(out.select(vec_of().alias("vec_id"), "ra", "dec"), "ra", "dec")


@query("snk05_manifest", "SELECT count(*) AS n, count(label) AS n_v FROM field", "sky field")
def snk05(s, d):
    """Rows and known magnitudes by the manifest of the written dataset."""
    listed = catalogue.manifest(s, path := dataset(s, d))
    return s.createDataFrame([(listed["rows"], catalogue.read(s, path).where("v_jkc_mag IS NOT NULL").count() if "v_jkc_mag" in listed["columns_present"] else 0)], "n long, n_v long")


@query("flt14_covers", "SELECT true AS inside, false AS outside")
def flt14(s, d):
    """Whether the written dataset covers its own middle, and a place without rows."""
    path = dataset(s, d)
    return s.createDataFrame([(catalogue.covers(s, path, 120.0, 10.0, 1.0), catalogue.covers(s, path, 300.0, -60.0, 1.0))], "inside boolean, outside boolean")


@query("set04_or_of_footprints", "SELECT DISTINCT vec_id FROM placed WHERE x >= 0 AND x < 400 AND y >= 0 AND y < 300", "sky pointings placed")
def set04(s, d):
    points = sky_points(s, d).withColumnRenamed("vec_id", "source_id")
    return stages.in_any_frame(points, pointings(s, d)).select(F.col("source_id").alias("vec_id"))


@query("flt04_footprint", "SELECT path, vec_id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM placed WHERE x >= -5 AND x < 405 AND y >= -5 AND y < 305", "sky pointings placed")
def flt04(s, d):
    points = sky_points(s, d).withColumnRenamed("vec_id", "source_id")
    return rounded(stages.sources_in_frames(points, pointings(s, d), 5.0).select("path", F.col("source_id").alias("vec_id"), "x", "y"), "x", "y", digits=4)


@query("orc05_build_stars", f"""SELECT source_id, round(60 * sep, 5) AS sep_target_arcmin, source_id = (SELECT arg_min(source_id, (sep, source_id)) FROM near) AS is_target FROM near""".replace("SELECT source_id, round", "WITH near AS (SELECT c_custkey AS source_id, " + SEP.format(a0=100.0, d0=10.0, a1="c_custkey % 360", d1="c_custkey % 120 - 60") + " AS sep FROM customer WHERE c_custkey IN (SELECT user_id FROM events)) SELECT source_id, round", 1))
def orc05(s, d):
    key = F.col("c_custkey")
    cat = read(s, d, "customer").select(key.alias("source_id"), (key % 360).cast("double").alias("ra"), (key % 120 - 60).cast("double").alias("dec"))
    out = ensemble.build_stars(cat, read(s, d, "events").withColumnRenamed("user_id", "source_id"), 100.0, 10.0)
    return rounded(out.select("source_id", "sep_target_arcmin", "is_target"), "sep_target_arcmin", digits=5)


# ------------------------------------------------------------------ headers

HEAD = """heads AS (SELECT o_orderkey AS k, o_custkey % 40 + 1 AS n, 10.0 * (o_custkey % 5 + 1) AS e, o_orderdate AS t, o_orderkey % 3 AS kind, o_custkey FROM orders)"""


def heads(s, d) -> DataFrame:
    """Frame headers in three dialects: native (TOTALEXP), server (NIMAGES and a span) and sparse."""
    o = read(s, d, "orders")
    n, e, kind = F.col("o_custkey") % 40 + 1, 10.0 * (F.col("o_custkey") % 5 + 1), F.col("o_orderkey") % 3
    text = lambda c: c.cast("string")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    both = [F.lit("XPIXSZ"), F.lit("2.9"), F.lit("FOCALLEN"), F.lit("250.0"), F.lit("RA"), text(F.col("o_custkey") % 360), F.lit("DEC"), text(F.col("o_custkey") % 90), F.lit("SITELAT"), F.lit("48.0"), F.lit("SITELONG"), F.lit("16.0"), F.lit("TELESCOP"), F.concat(F.lit("S50_u"), text(F.col("o_custkey") % 7))]
    native = F.create_map(F.lit("STACKCNT"), text(n), F.lit("EXPTIME"), text(e), F.lit("TOTALEXP"), text(n * e), F.lit("DATE-OBS"), stamp, *both)
    server = F.create_map(F.lit("NIMAGES"), text(n), F.lit("EXPTIME"), text(n * e), F.lit("OB-START"), stamp, F.lit("OB-END"), F.date_format(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 600 SECONDS"), "yyyy-MM-dd HH:mm:ss"), F.lit("PIXSCALE"), F.lit("2.5"), *both)
    sparse = F.create_map(F.lit("STACKCNT"), text(n), F.lit("EXPOSURE"), text(e), F.lit("DATE-OBS"), stamp)
    return o.select(F.col("o_orderkey").alias("k"), F.when(kind == 0, native).when(kind == 1, server).otherwise(sparse).alias("header"))


@query("fn12_exposure", f"WITH {HEAD} SELECT k, n::DOUBLE AS n_exp, e::DOUBLE AS exptime, (n * e)::DOUBLE AS total_exptime FROM heads")
def fn12(s, d):
    from .functions import headers

    return heads(s, d).select("k", *[c.alias(name) for name, c in headers.exposure().items()])


@query("fn14_frame_times", f"""WITH {HEAD} SELECT k, round(m, 6) AS mjd_obs, round(m + CASE kind WHEN 1 THEN 300 ELSE n * e / 2 END / 86400, 6) AS mjd_mid, CASE kind WHEN 1 THEN 'span' ELSE 'start+half' END AS time_source
    FROM (SELECT *, epoch_us(t) / 86400000000.0 + 40587 AS m FROM heads)""")  # fmt: skip
def fn14(s, d):
    from .functions import headers

    times = headers.frame_times()
    return rounded(heads(s, d).select("k", *[times[c].alias(c) for c in ("mjd_obs", "mjd_mid", "time_source")]), "mjd_obs", "mjd_mid")


@query("fn15_unit_model_scale", f"WITH {HEAD} SELECT k, CASE WHEN kind < 2 THEN 'u' || (o_custkey % 7) ELSE '' END AS unit, CASE WHEN kind < 2 THEN 'S50' ELSE 'S30pro' END AS model, CASE kind WHEN 0 THEN round(206.265 * 2.9 / 250, 6) WHEN 1 THEN 2.5 END AS pixscale FROM heads")
def fn15(s, d):
    from .functions import headers

    return rounded(heads(s, d).select("k", headers.unit_id().alias("unit"), headers.model_of().alias("model"), headers.pixel_scale().alias("pixscale")), "pixscale")


@query("fn16_airmass", f"""WITH {HEAD} SELECT k, CASE WHEN kind < 2 AND alt > 0.05 THEN round(1 / alt, 4) END AS airmass FROM (SELECT *, sin(radians(48.0)) * sin(radians(o_custkey % 90)) + cos(radians(48.0)) * cos(radians(o_custkey % 90)) * cos(radians(gmst + 16.0 - o_custkey % 360)) AS alt
    FROM (SELECT *, 280.46061837 + 360.98564736629 * (epoch_us(t) / 86400000000.0 + 40587 - 51544.5) AS gmst FROM heads))""")  # fmt: skip
def fn16(s, d):
    from .functions import headers

    out = rounded(heads(s, d).select("k", headers.frame_times()["airmass"].alias("airmass")), "airmass", digits=4)
    return out.withColumn("airmass", F.when(F.col("airmass") < 20, F.col("airmass")))


# ------------------------------------------------------------------ diagnostics

POINT_VIEW = """pt AS (SELECT strftime(l_shipdate, '%Y') AS frame, l_returnflag AS band, l_extendedprice AS flux, l_quantity AS x_pix, l_tax * 100 AS y_pix, l_discount - 0.05 AS resid, l_linenumber <> 3 AS keep, l_orderkey, l_linenumber, l_suppkey AS source_id, sqrt(l_extendedprice) AS snr FROM lineitem)"""


def point_rows(s, d) -> DataFrame:
    return read(s, d, "lineitem").select(
        F.date_format("l_shipdate", "yyyy").alias("frame"), F.col("l_returnflag").alias("band"), F.col("l_extendedprice").alias("flux"), F.col("l_quantity").alias("x_pix"), (F.col("l_tax") * 100).alias("y_pix"),
        (F.col("l_discount") - 0.05).alias("resid"), (F.col("l_linenumber") != 3).alias("keep"), "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source_id"), F.sqrt("l_extendedprice").alias("snr"),
    )


@query("dia02_fwhm_bands", """SELECT frame, round(r, 6) AS "fwhm_R", round(g, 6) AS "fwhm_G", round(b, 6) AS "fwhm_B", CASE WHEN g > 0 THEN round(r / g, 6) END AS "R_over_G", CASE WHEN g > 0 THEN round(b / g, 6) END AS "B_over_G"
    FROM (SELECT l_suppkey AS frame, avg(l_quantity) FILTER (l_returnflag = 'R') AS r, avg(l_quantity) FILTER (l_returnflag = 'N') AS g, avg(l_quantity) FILTER (l_returnflag = 'A') AS b FROM lineitem GROUP BY 1)""")  # fmt: skip
def dia02(s, d):
    band = F.when(F.col("l_returnflag") == "R", "R").when(F.col("l_returnflag") == "N", "G").otherwise("B")
    bands = read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("frame"), band.alias("band")).agg(F.avg("l_quantity").alias("fwhm"))
    return rounded(diagnostics.fwhm_bands(bands), "fwhm_R", "fwhm_G", "fwhm_B", "R_over_G", "B_over_G")


@query("dia01_curve_of_growth", f"WITH {STARS_SQL}, a AS (SELECT l_returnflag AS band, max(l_quantity) / 10 AS aperture FROM lineitem GROUP BY 1) SELECT 'f' AS frame, band, radius, round(flux_frac, 6) AS flux_frac, n_stars, round(aperture, 6) AS aperture FROM cog JOIN a USING (band)")
def dia01(s, d):
    bands = read(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("band")).agg((F.max("l_quantity") / 10).alias("aperture")).withColumn("frame", F.lit("f"))
    out = diagnostics.curve_of_growth(growth_rows(s, d).withColumn("frame", F.lit("f")), bands)
    return rounded(out.select("frame", "band", "radius", "flux_frac", "n_stars", "aperture"), "flux_frac", "aperture")


@query("dia05_residual_vs_radius", f"""WITH {POINT_VIEW}, r AS (SELECT frame, l_orderkey, l_linenumber, resid, sqrt(pow(x_pix - median(x_pix) OVER (PARTITION BY frame), 2) + pow(y_pix - median(y_pix) OVER (PARTITION BY frame), 2)) AS radius FROM pt)
    SELECT frame, round(radius, 5) AS x, round(resid, 5) + 0.0 AS y, count(*) AS n FROM r GROUP BY 1, 2, 3""")  # fmt: skip
def dia05(s, d):
    points, _ = diagnostics.residual_vs(point_rows(s, d), "radius")
    return rounded(points, "x", "y", digits=5).groupBy("frame", "x", "y").agg(F.count("*").alias("n"))


@query("dia06_residual_map", f"WITH {POINT_VIEW} SELECT frame, x_pix, round(y_pix, 4) + 0.0 AS y_pix, round(resid, 5) + 0.0 AS resid, round(span, 5) AS span, count(*) AS n FROM (SELECT *, quantile_cont(abs(resid), 0.95) OVER (PARTITION BY frame) AS span FROM pt WHERE keep) GROUP BY ALL")
def dia06(s, d):
    out = rounded(rounded(diagnostics.residual_map(point_rows(s, d)), "resid", "span", digits=5), "y_pix", digits=4)
    return out.groupBy("frame", "x_pix", "y_pix", "resid", "span").agg(F.count("*").alias("n"))


@query("dia07_mag_snr", f"WITH {POINT_VIEW} SELECT frame, band, round(-2.5 * log10(flux), 4) + 0.0 AS m_inst, round(snr, 4) AS snr, count(*) AS n FROM pt WHERE flux > 0 GROUP BY ALL")
def dia07(s, d):
    return rounded(diagnostics.mag_snr(point_rows(s, d)), "m_inst", "snr", digits=4).groupBy("frame", "band", "m_inst", "snr").agg(F.count("*").alias("n"))


@query("dia08_background_panels", """WITH t AS (SELECT strftime(l_shipdate, '%Y') AS frame, l_quantity AS background, l_discount * 100 AS model FROM lineitem),
    v AS (SELECT frame, unnest(['background', 'model', 'residual']) AS panel, unnest([background, model, background - model]) AS value FROM t)
    SELECT frame, panel, round(quantile_cont(value, 0.01), 5) + 0.0 AS p1, round(quantile_cont(value, 0.5), 5) + 0.0 AS p50, round(quantile_cont(value, 0.99), 5) + 0.0 AS p99 FROM v GROUP BY 1, 2""")  # fmt: skip
def dia08(s, d):
    tiles = read(s, d, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("frame"), F.col("l_quantity").cast("double").alias("background"), (F.col("l_discount") * 100).cast("double").alias("model"))
    return rounded(diagnostics.background_panels(tiles), "p1", "p50", "p99", digits=5)


@query("dia09_detection_overlay", "SELECT l_orderkey, l_linenumber, l_suppkey % 2 = 0 AS matched FROM lineitem WHERE abs(l_quantity - 25) <= 10 AND abs(l_linenumber - 3.5) <= 10")
def dia09(s, d):
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("band"), F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("y"), *[F.lit(1.0).alias(c) for c in ("a", "b", "theta")], F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("source_id"))
    return diagnostics.detection_overlay(rows, 50, 7, 10).select(F.col("frame").alias("l_orderkey"), F.col("band").alias("l_linenumber"), "matched")


@query("dia11_instrumental_colour", """WITH s AS (SELECT strftime(l_shipdate, '%Y') AS frame, l_suppkey AS source_id, arg_max(-2.5 * log10(l_extendedprice), l_extendedprice) FILTER (l_returnflag = 'R') AS mr, arg_max(-2.5 * log10(l_extendedprice), l_extendedprice) FILTER (l_returnflag = 'A') AS ma FROM lineitem GROUP BY 1, 2)
    SELECT frame, source_id, round(ma - mr, 5) + 0.0 AS inst, source_id / 10.0 AS cat FROM s WHERE mr IS NOT NULL AND ma IS NOT NULL""")  # fmt: skip
def dia11(s, d):
    p = point_rows(s, d).withColumn("band", F.when(F.col("band") == "A", "B").otherwise(F.col("band")))
    p = p.withColumn("b_jkc_mag", 1 + F.col("source_id") / 10.0).withColumn("r_jkc_mag", F.lit(1.0))
    return rounded(diagnostics.instrumental_colour(p), "inst", "cat", digits=5)


@query("dia13_metric_histogram", "SELECT count(*) AS n, count(*) FILTER (rms < 0.03) AS below FROM frames", "frames")
def dia13(s, d):
    return diagnostics.metric_histogram(frames(s, d), "rms", 0.03)[1]


@query("agg17_histogram_ends", "SELECT least(l_quantity - 1, 48)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def agg17_ends(s, d):
    """Between the extremes that the data have: 1 to 50."""
    rows = read(s, d, "lineitem").select(F.col("l_quantity").cast("double").alias("v"))
    return period.histogram(rows, "v", 49).select(F.col("bin").cast("long").alias("bin"), "n")


@query("dia14_depth_vs_driver", "SELECT unit, round(regr_slope(y, sky_sb), 6) + 0.0 AS slope, round(regr_intercept(y, sky_sb), 6) AS intercept, count(*) AS n FROM (SELECT unit, sky_sb, v_lim_5sigma + 1.25 * log10(900 / total_exptime) AS y FROM frames WHERE rms < 0.06) GROUP BY unit HAVING count(*) > 5", "frames")
def dia14_driver(s, d):
    return rounded(diagnostics.depth_vs_driver(frames(s, d), "sky_sb")[1], "slope", "intercept")


@query("dia16_raw_flux", "SELECT time AS bjd_tdb, round(flux, 4) AS flux, round(sqrt(flux), 4) AS fluxerr FROM meas WHERE source_id = 7 AND band = 'click'", "meas")
def dia16_raw(s, d):
    m = meas(s, d).withColumn("bjd_tdb", F.col("time")).withColumn("fluxerr", F.sqrt("flux"))
    return rounded(diagnostics.raw_flux(m, 7, "click"), "flux", "fluxerr", digits=4)


@query("dia16_ensemble_zeropoint", lc_sql("SELECT round(time, 6) AS time, round(zp_ens, 6) AS zp_ens, round(zp_ens - zp_scatter, 6) AS low, round(zp_ens + zp_scatter, 6) AS high FROM lc"), "meas stars")
def dia16_zp(s, d):
    return rounded(diagnostics.ensemble_zeropoint(lightcurve(s, d)), "time", "zp_ens", "low", "high")


@query("dia17_comparison_grid", joined(f"SELECT r.rank::INT AS rank, c.source_id, round(c.time, 5) AS time, round(c.dmag, 4) + 0.0 AS dmag FROM (SELECT c0.*, m.time FROM curves c0 JOIN meas m ON m.source_id = c0.source_id AND m.frame = c0.frame AND m.band = 'click') c JOIN (SELECT source_id, row_number() OVER (ORDER BY scatter DESC, source_id) AS rank FROM ({RANK}) QUALIFY rank <= 16) r USING (source_id)", LOO), "meas stars")
def dia17(s, d):
    return rounded(rounded(diagnostics.comparison_grid(curves(s, d)).select("rank", "source_id", "time", "dmag"), "time", digits=5), "dmag", digits=4)


@query("dia10_match_separation", joined("SELECT count(*)::BIGINT AS n FROM near WHERE b.sep < 3 * 7200 AND b.sep > 0", XM), "sky")
def dia10(s, d):
    det, cat = sides(s, d)
    matched = match.crossmatch(det, cat, "det_id", 7200.0, ("source_id",), radii_deg=(4.0, 16.0))
    return diagnostics.match_separation(matched, 7200.0).agg(F.sum("n").alias("n"))


@query("dia14_depth_vs_exptime", "SELECT model, total_exptime, round(v_lim_5sigma, 6) AS v_lim_5sigma, round(median(v_lim_5sigma) OVER (PARTITION BY model) + 1.25 * log10(total_exptime / median(total_exptime) OVER (PARTITION BY model)), 6) AS line FROM frames WHERE rms < 0.06", "frames")
def dia14(s, d):
    return rounded(diagnostics.depth_vs_exptime(frames(s, d)), "v_lim_5sigma", "line")


@query("dia16_lightcurve", lc_sql("SELECT round(time, 6) AS time, round(dmag, 6) + 0.0 AS dmag, round(mag_err, 6) AS mag_err, round(stddev_pop(dmag) OVER (), 6) AS scatter, round(median(mag_err) OVER (), 6) AS median_err FROM lc"), "meas stars")
def dia16(s, d):
    return rounded(diagnostics.lightcurve(lightcurve(s, d)), "time", "dmag", "mag_err", "scatter", "median_err")


@query("dia18_scatter_vs_magnitude", joined(f"SELECT r.source_id, round(c.v_jkc_mag, 6) AS mag, round(1000 * r.scatter, 2) AS scatter_mmag, (SELECT round(1000 * min(CASE WHEN scatter > 1e-9 THEN scatter END), 2) FROM ({RANK})) AS floor_mmag FROM ({RANK}) r JOIN comps c USING (source_id)", LOO), "meas stars")
def dia18(s, d):
    out = diagnostics.scatter_vs_magnitude(curves(s, d), comparisons(s, d))
    return rounded(rounded(out, "mag"), "scatter_mmag", "floor_mmag", digits=2)


# Names of the first round, for the same whole queries.
for _old, _new in (("join11_nn", "join11_all_nn"), ("srt01_frames_sorted", "srt01_all_frames_sorted")):
    QUERIES[_old], ORACLE[_old] = QUERIES[_new], ORACLE[_new]
