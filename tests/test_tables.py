import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlode import registry
from starlode.functions import scalar, sky
from starlode.operators import calibrate, depth, diagnostics, ensemble, match, period, solve
from starlode.sources import catalogue as cat


@pytest.fixture(scope="module")
def series(spark):
    """40 frames x 12 stars; star 1 varies, star 5 is a rogue; a drift of 0.35 mag."""
    rng = np.random.default_rng(3)
    t, mags = 2460000.0 + np.linspace(0, 0.35, 40), np.linspace(11, 13, 12)
    zp = 21.5 - 0.35 * np.linspace(0, 1, 40)
    rows = []
    for f in range(40):
        for s in range(12):
            m = mags[s] - zp[f] + rng.normal(0, 0.004) + (0.08 * math.sin(2 * math.pi * t[f] / 0.1294) if s == 0 else 0) + (0.10 * math.sin(2 * math.pi * t[f] / 0.07) if s == 4 else 0)
            rows.append((s + 1, f"f{f:02}", "G", float(t[f]), 1.2, float(m), 0.004, 0, True))
    meas = spark.createDataFrame(rows, "source_id int, frame string, band string, bjd_tdb double, airmass double, m_inst double, mag_err double, flag int, on_chip boolean")
    stars = spark.createDataFrame([(s + 1, 10.0, 20.0 + s / 60, float(mags[s]), 0.8, "NOT_AVAILABLE", float(s), s == 0) for s in range(12)], "source_id long, ra double, dec double, v_jkc_mag double, bp_rp double, phot_variable_flag string, sep_target_arcmin double, is_target boolean")
    return meas.cache(), stars.cache()


def test_ensemble_removes_the_drift_and_finds_the_period(series):
    meas, stars = series
    comps = ensemble.select_comparisons(stars, mag_range=(11, 13)).where("source_id <> 5")
    lc = ensemble.differential_lightcurve(meas, 1, comps)
    got = lc.collect()
    assert len(got) == 40 and abs(np.polyfit([r["time"] for r in got], [r["dmag"] for r in got], 1)[0]) < 0.2
    found = period.search(lc, max_period=0.3)
    assert abs(found["best_period"] / 0.1294 - 1) < 0.02 and found["fap"] < 1e-6
    assert period.phase_bins(period.fold(lc, found["best_period"])).count() > 10
    with pytest.raises(ValueError, match="at least 5"):
        period.periodogram(lc.limit(2))
    assert ensemble.differential_lightcurve(meas.where("false"), 1, comps).columns == lc.columns


def test_leave_one_out_equals_deletion_and_ranks_the_rogue(series):
    meas, stars = series
    comps = stars.where("source_id <> 1")
    curves = ensemble.comparison_curves(meas, comps)
    for c in (2, 5):
        one = {r["frame"]: r for r in ensemble.differential_lightcurve(meas, c, comps.where(F.col("source_id") != c)).collect()}
        for r in curves.where(F.col("source_id") == c).collect():
            assert abs(r["mag"] - one[r["frame"]]["mag"]) < 1e-9 and abs(r["zp_scatter"] - one[r["frame"]]["zp_scatter"]) < 1e-9 and r["n_comp"] == one[r["frame"]]["n_comp"]
    ranking = ensemble.scatter_ranking(curves)
    assert ranking.first()["source_id"] == 5 and ranking.first()["check"]
    assert diagnostics.comparison_grid(curves, 3).select("source_id").distinct().count() == 3
    assert diagnostics.scatter_vs_magnitude(curves, comps).count() == 11


def test_build_stars(series):
    meas, stars = series
    catalogue = stars.drop("sep_target_arcmin", "is_target").union(stars.drop("sep_target_arcmin", "is_target").where("source_id = 1").withColumn("source_id", F.lit(99)))
    got = ensemble.build_stars(catalogue, meas, 10.0, 20.005)
    assert got.count() == 12 and got.first()["source_id"] == 1 and ensemble.target_row(got).first()["source_id"] == 1
    with pytest.raises(ValueError):
        ensemble.build_stars(catalogue, meas, 10.0, 20.0, target_id=99)


def test_zero_point_fit_equals_the_loop(spark):
    rng = np.random.default_rng(5)
    n = 80
    v, c = rng.uniform(10, 14, n), rng.uniform(0.3, 1.8, n)
    m = v - 21.5 - 0.12 * (c - np.median(c)) + rng.normal(0, 0.02, n)
    m[:4] += 1.0
    rows = [("f", "G", float(10 ** (-0.4 * b)), 50.0, float(a), float(a + d / 2), float(a - d / 2), "NOT_AVAILABLE") for a, b, d in zip(v, m, c)]
    df = spark.createDataFrame(rows, "frame string, band string, flux double, snr double, v_jkc_mag double, b_jkc_mag double, r_jkc_mag double, phot_variable_flag string")
    got = calibrate.fit_zeropoint(df).first()
    x, r, keep = c - np.median(c), v - m, np.ones(n, bool)
    for _ in range(3):
        (k, zp), cov = np.polyfit(x[keep], r[keep], 1, cov=True)
        resid = r - zp - k * x
        used, keep = keep, np.abs(resid) < 3 * resid[keep].std()
    want = (zp, cov[1, 1] ** 0.5, k, cov[0, 0] ** 0.5, keep.sum(), resid[keep].std(), ((resid[keep] * 50 / 1.0857) ** 2).sum() / (keep.sum() - 2))
    mine = [got[c] for c in ("zeropoint", "zeropoint_err", "colour_term", "colour_term_err", "n_stars", "rms", "chi2_red")]
    assert np.allclose(mine, want, rtol=1e-8) and got["n_stars"] <= 76
    assert calibrate.fit_zeropoint(df.limit(2)).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (float("nan"),), (100.0,), (None,)], "x double")
    got = [r[0] for r in df.select(scalar.instrumental_mag("x")).collect()]
    assert got == [None, None, None, -5.0, None]
    b = spark.createDataFrame([(22.0,), (20.0,), (16.0,), (None,)], "x double").select(scalar.effective_bortle("x")).collect()
    assert [r[0] for r in b] == [1.0, 5.0, 9.0, None]
    s = spark.range(1).select(scalar.sky_surface_brightness(F.lit(800.0), F.lit(21.5), F.lit(2.39))).first()[0]
    assert abs(s - 16.13) < 0.01
    sat = spark.createDataFrame([("f", 65535.0, 8.0), ("f", 65000.0, 9.5), ("f", 1000.0, 12.0), ("f", 500.0, 13.0)], "frame string, max_pix_value double, v_jkc_mag double")
    assert calibrate.saturation_mag(sat).first()["v_sat"] == 9.5
    assert [r[0] for r in spark.createDataFrame([(" V* AB Cet! ",), ("***",)], "x string").select(scalar.slug("x")).collect()] == ["v__ab_cet", "field"]


@pytest.mark.parametrize("where", [(186.6821, 81.474), (0.3, 12.0), (120.0, 89.5)])
def test_crossmatch_equals_brute_force(spark, where):
    rng = np.random.default_rng(7)
    ra, dec = (where[0] + rng.uniform(-2, 2, 200) / max(math.cos(math.radians(where[1])), 0.02)) % 360, np.clip(where[1] + rng.uniform(-2, 2, 200), -90, 90)
    det = spark.createDataFrame([(i, float(ra[i] + 1e-4), float(min(dec[i] + 1e-4, 90))) for i in range(80)] + [(500, 10.0, -60.0)], "k long, ra double, dec double")
    rows = [(i, float(ra[i]), float(dec[i]), None if i % 3 else 12.0) for i in range(200)]
    got = {r["k"]: r for r in match.crossmatch(det, spark.createDataFrame(rows, "source_id long, ra double, dec double, v_jkc_mag double"), "k", 2.0).collect()}
    for r in det.collect():
        sep = sky.separation(r["ra"], r["dec"], ra, dec) * 3600
        j, g = int(sep.argmin()), got[r["k"]]
        assert abs(g["sep_arcsec"] - sep[j]) < 1e-4 and g["source_id"] == (j if sep[j] < 2 else None) and g["v_jkc_mag"] == (rows[j][3] if sep[j] < 2 else None)


def test_pixel_centres_agree_with_ids_and_cover_the_sphere():
    ra, dec = sky.pixel_centres(5)
    v = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))])
    assert len(np.unique(np.round(v, 9), axis=1).T) == 12288 and np.abs(v.mean(axis=1)).max() < 1e-12
    parent_ra, parent_dec = sky.pixel_centres(4)
    assert max(sky.separation(parent_ra[i // 4], parent_dec[i // 4], ra[i], dec[i]) for i in range(0, 12288, 7)) < 3.9
    rng = np.random.default_rng(1)
    for _ in range(50):
        p = rng.standard_normal(3)
        p /= np.linalg.norm(p)
        assert np.degrees(np.arccos(np.clip((p @ v).max(), -1, 1))) <= 1.91


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    ra0, dec0 = sky.pixel_centres()
    ra, dec = 186.6821 + rng.uniform(-2, 2, 600) / math.cos(math.radians(81.474)), 81.474 + rng.uniform(-2, 2, 600)
    pix = [int(sky.separation(a, d, ra0, dec0).argmin()) for a, d in zip(ra, dec)]
    g = np.linspace(9, 17.4, 600)
    rows = [((p << 49) + i, float(a % 360), float(d), float(m), None if i % 3 == 0 else 1.1, float(m), 10.0, 7.5, "VARIABLE" if i % 50 == 0 else "NOT_AVAILABLE", "true" if i % 2 else "F") for i, (p, a, d, m) in enumerate(zip(pix, ra, dec, g))]
    df = spark.createDataFrame(rows, "source_id long, ra double, dec double, phot_g_mean_mag double, ruwe double, v_jkc_mag double, pmra double, pmdec double, phot_variable_flag string, duplicated_source string")
    path = f"file://{tmp_path_factory.mktemp('cat')}/ds"
    return df, path, cat.write_dataset(df, path)


@pytest.mark.parametrize("radius", [0.2, 0.7, 1.5])
def test_cone_equals_a_full_cut(spark, dataset, radius):
    df, path, _ = dataset
    got = {r[0] for r in cat.cone(spark, path, 186.6821, 81.474, radius).select("source_id").collect()}
    assert got == {r["source_id"] for r in df.collect() if sky.separation(186.6821, 81.474, r["ra"], r["dec"]) <= radius} and got


def test_dataset_contracts(spark, dataset):
    df, path, made = dataset
    assert made["rows"] == 600 and cat.manifest(spark, path) == made and "ruwe" in made["columns_present"] and "c_star" not in made["columns_present"]
    plan = cat.cone(spark, path, 186.6821, 81.474, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "hpx5" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert cat.covers(spark, path, 186.6821, 81.474, 0.5) and not cat.covers(spark, path, 10.0, -40.0, 0.5)
    with pytest.raises(FileNotFoundError):
        cat.cone(spark, path, 10.0, -40.0, 0.5)
    old, new = cat.cone(spark, path, 186.6821, 81.474, 1.0).orderBy("source_id").first(), cat.cone(spark, path, 186.6821, 81.474, 1.0, epoch=3016.0).orderBy("source_id").first()
    assert abs(sky.separation(old["ra"], old["dec"], new["ra"], new["dec"]) * 3600 - math.hypot(10, 7.5)) < 0.1
    assert cat.cone(spark, path, 186.6821, 81.474, 1.5, vmag_limit=12.0).agg(F.max("v_jkc_mag")).first()[0] < 12
    with pytest.raises(ValueError):
        cat.write_part(df, path, 0)
    with pytest.raises(ValueError):
        cat.conform(df.drop("ra"))
    with pytest.raises(ValueError):
        cat.write_dataset(df.union(df.limit(1)), path + "_twice")
    some = df.limit(3).withColumn("v_jkc_mag", F.lit(5.0))
    after = cat.upsert(spark, some, path)
    assert after["rows"] == 600 and cat.read(spark, path).where("v_jkc_mag = 5").count() == 3


def test_depth_model_equals_least_squares(spark):
    rng = np.random.default_rng(42)
    t, sky_sb, fwhm = rng.choice([300.0, 600, 900], 60), rng.uniform(18, 21, 60), rng.uniform(2, 4, 60)
    v = 10 + 1.25 * np.log10(t) + 0.3 * sky_sb - 0.2 * fwhm + rng.normal(0, 0.05, 60)
    df = spark.createDataFrame([("u", float(a), float(b), float(c), float(d), 0.03) for a, b, c, d in zip(v, t, sky_sb, fwhm)], "unit string, v_lim_5sigma double, total_exptime double, sky_sb double, fwhm_G double, rms double")
    got = depth.fit_depth_model(df, keys=("unit",)).first()
    terms = np.stack([np.ones(60), np.log10(t), sky_sb, fwhm], 1)
    beta = np.linalg.lstsq(terms, v, rcond=None)[0]
    assert np.allclose([got[c] for c in "abcd"], beta, atol=1e-5) and abs(got["rms"] - (v - terms @ beta).std()) < 1e-5 and got["n"] == 60


def test_small_parts(spark):
    assert solve.tolerance_ladder(120, 3) == [120, 40, 120 / 9, 120 / 27, 3, 1.5, 1.0]
    assert solve.strided(spark.range(100), "id", 30).count() == 25
    h = period.histogram(spark.range(101).select(F.col("id").cast("double").alias("v")), "v", 10).collect()
    assert [r["n"] for r in h] == [10] * 9 + [11]
    assert period.histogram(spark.createDataFrame([(1.0,), (10.0,), (100.0,), (float("nan"),), (-1.0,)], "v double"), "v", 2, log=True).agg(F.sum("n")).first()[0] == 3


def test_registry_and_sql_agree(spark):
    duckdb = pytest.importorskip("duckdb")
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("agg01_ensemble_lc", "fit01_zeropoint", "agg09_leave_one_out", "join01_crossmatch"):
        mine = registry.QUERIES[name](spark, d).toPandas()
        other = con.execute(registry.ORACLE[name]).df()[list(mine.columns)]
        key = list(mine.columns)
        a, b = mine.sort_values(key).reset_index(drop=True), other.sort_values(key).reset_index(drop=True)
        assert len(a) == len(b)
        for c in key:
            assert (a[c].astype(str) == b[c].astype(str)).all() or np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-4, equal_nan=True), (name, c)


def test_frames_are_sorted_whole(spark):
    d = "/root/testdata/sf0.01"
    want = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderpriority", "o_orderdate", "o_orderkey").collect()
    got = [tuple(r) for r in registry.QUERIES["srt01_all_frames_sorted"](spark, d).collect()]
    assert len(want) > 500 and got == sorted(tuple(r) for r in want)


def test_nearest_neighbours_are_among_all_points(spark):
    d = "/root/testdata/sf0.001"
    rows = registry.sky_points(spark, d).collect()
    ids, p = [r["vec_id"] for r in rows], np.array([(r["ra"], r["dec"]) for r in rows])
    apart = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    want = {i: v if v <= 20 else None for i, v in zip(ids, apart.min(1))}
    got = {r["det_id"]: r["nn_dist"] for r in registry.QUERIES["join11_all_nn"](spark, d).collect()}
    assert got.keys() == want.keys() and any(i % 2 for i in got)
    assert all((got[i] is None) == (v is None) and (v is None or abs(got[i] - v) < 1e-5) for i, v in want.items())
