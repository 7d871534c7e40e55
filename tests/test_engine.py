"""Stages, reports, stacks, host light, sources and sinks of frames."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from synthetic_frames import CATALOGUE, CENTRE, HEADER, NX, NY, catalogue_rows, cube, truth, wcs

from starlode import examples
from starlode.functions import headers, sky
from starlode.operators import diagnostics, match, solve
from starlode.pixels import photometry as ph
from starlode.pixels import solver
from starlode.plans import extras, reports, stacking, stages
from starlode.plans.project import Project, Target
from starlode.sources import archive, catalogue, ecsv, fits, frames


def write(path, planes, header=HEADER):
    path.write_bytes(fits.write_fits(planes, header))
    return str(path)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    """Two good frames, one whose solution leads away from the catalogue and one without a solution; provenance that overrides a column; all details."""
    root, t = tmp_path_factory.mktemp("run"), truth()
    (root / "in").mkdir()
    solved = HEADER | wcs().to_header() | {"PLTSOLVD": True}
    for i in range(2):
        write(root / "in" / f"f{i}.fits", [("", cube(t, 300 + i))], solved | {"DATE-OBS": f"2026-07-24T22:0{i}:00", "ZPG": 21.0 + i})
    write(root / "in" / "empty.fits", [("", cube(t, 305))], solved | {"CRVAL1": 10.0, "CRVAL2": -20.0})
    write(root / "in" / "unsolved.fits", [("", cube(t, 310))])
    cat = f"{root}/cat"
    spark.createDataFrame(catalogue_rows(t), CATALOGUE).write.parquet(cat)
    p = Project(
        Target("MW Cam", *CENTRE), f"file://{root}/in", f"file://{root}/work", solver="lift", fetch=lambda s, *_: s.read.parquet(cat), catalogue_backend="fetch",
        provenance=lambda frame: {"night": 7, "quality": 0.5, "object": "OVERRIDDEN", "good": True}, attempts=2, wait_s=0.0,
    )
    assert stages.solve_all(spark, p) == {"ok": 3, "failed": 1}
    stages.build_frame_table(spark, p)
    return p


def test_frames_without_a_fit_have_a_row_and_are_done(spark, project):
    rows = {r["frame"]: r for r in spark.read.parquet(project.frames_path).collect()}
    assert set(rows) == {"f0.fits", "f1.fits", "empty.fits"}
    assert rows["empty.fits"]["zeropoint"] is None and rows["empty.fits"]["n_cal"] == 0 and rows["f0.fits"]["n_cal"] > 30
    status = {r["path"].rpartition("/")[2]: r["status"] for r in spark.read.parquet(project.status_path).where("stage = 'characterise'").collect()}
    assert status == {"f0.fits": "ok", "f1.fits": "ok", "empty.fits": "no_fit", "unsolved.fits": "no_wcs"}
    before = spark.read.parquet(project.frames_path).count()
    stages.build_frame_table(spark, project)
    assert spark.read.parquet(project.frames_path).count() == before
    stages.build_frame_table(spark, project, force=True)
    assert spark.read.parquet(project.frames_path).count() == before and spark.read.parquet(project.path("bands")).where("frame LIKE '%f0.fits'").count() == 3


def test_provenance_is_typed_and_overrides(spark, project):
    t = spark.read.parquet(project.frames_path)
    kinds = dict(t.dtypes)
    assert (kinds["night"], kinds["quality"], kinds["good"]) == ("bigint", "double", "boolean")
    assert {r["object"] for r in t.collect()} == {"OVERRIDDEN"}
    assert "onboard_zp_G" in kinds and "onboard_sqm" not in kinds


def test_reports_have_their_products(spark, project, tmp_path):
    per_frame = reports.frame_report(spark, project)
    assert len(per_frame) == 13 and all(df.count() > 0 for df in per_frame.values())
    radius = per_frame["residual_vs_radius"].where("part = 'point'")
    assert radius.agg(F.max("x")).first()[0] < math.hypot(NX, NY)
    spread = per_frame["residual_map"].agg(F.max("x_pix"), F.max("y_pix")).first()
    assert 300 < spread[0] < NX and 250 < spread[1] < NY
    pedestal = per_frame["background_panels"].where("panel = 'background'").agg(F.avg("p50")).first()[0]
    assert abs(pedestal - 800) < 3
    assert per_frame["curve_of_growth"].where("aperture IS NOT NULL").count() > 0
    one = next(iter(reports.sample_frame_reports(spark, project, 1).values()))
    assert one["fwhm_bands"].count() == 1
    whole = reports.frames_report(spark, project)
    assert len(whole) >= 12 and whole["series_zeropoint"].count() == 2
    with pytest.raises(ValueError, match="measured"):
        reports.lightcurve_report(spark, project)
    stages.build_measurements(spark, project)
    assert reports.measurements_report(spark, project)["frame_quality"].count() == 2
    lc = reports.lightcurve_report(spark, project, mag_range=(9, 15), colour_tol=None, wcs={k: v for k, v in zip(("crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22"), (*wcs().crpix, *wcs().crval, *wcs().cd.ravel()))})
    assert "periodogram" not in lc and lc["lightcurve"].count() == 2 and lc["finder_chart"].where("role = 'target'").count() == 1
    written = diagnostics.write_report({"summary": lc["summary"], "bad": spark.range(1).selectExpr("raise_error('x') AS x")}, f"file://{tmp_path}/report")
    assert written["summary"].endswith("summary") and written["bad"].startswith("failed")


def test_host_light_and_kron_as_tables(spark, project):
    keys = project.frames(spark).where("path LIKE '%f_.fits' OR path LIKE '%unsolved%'")
    nucleus, target = tuple(float(v[0]) for v in wcs().to_world(np.array([66.3]), np.array([66.0]))), tuple(float(v[0]) for v in wcs().to_world(np.array([90.3]), np.array([89.8])))
    rows = extras.host_azimuths(spark, project, keys, nucleus, target)
    assert {r["status"] for r in rows.select("status").distinct().collect()} == {"ok", "no_wcs"}
    zero = spark.read.parquet(project.frames_path).select(F.col("path").alias("frame"), "zeropoint", "zeropoint_err")
    got = extras.corrected(rows, zero).collect()
    t = truth()
    v = t["v"][8]  # the star at (90.3, 89.8)
    assert len(got) == 2 and all(r["n"] >= 4 and abs(r["mag"] - v) < 0.2 and 0 < r["mag_err"] < 0.2 for r in got)
    kron = extras.kron_sources(keys)
    assert kron.where("status = 'ok'").groupBy("path").count().agg(F.min("count")).first()[0] > 100
    stamp = extras.host_cutouts(spark, project, keys, nucleus, target, half=20).where("status = 'ok'").first()
    assert len(stamp["stamp"]) == 4 * stamp["ny"] * stamp["nx"] and stamp["ny"] <= 41


def test_stacks_of_many_fields(spark, tmp_path):
    t, rows = truth(), []
    for field, n in (("a", 4), ("b", 2)):
        for i in range(n):
            path = write(tmp_path / f"{field}{i}.fits", [("", cube(t, 100 + i, (2.0 * i, -1.5 * i)))], HEADER | {"EXPTIME": 10.0, "TOTALEXP": None, "CRVAL1": 3.0})
            rows.append((field, path, i))
    rows.append(("a", write(tmp_path / "bad.fits", [("", np.full((3, NY, NX), 800.0, np.float32))]), 9))
    out = {r["field"]: r for r in stacking.stack(spark, spark.createDataFrame(rows, "field string, path string, place int"), str(tmp_path / "out"), weight_plane=True).collect()}
    assert (out["a"]["n_in"], out["a"]["n_ok"], out["a"]["n_bad"], out["b"]["n_ok"]) == (5, 4, 1, 2)
    assert out["a"]["resid_median_px"] < 0.3 and out["a"]["total_exptime"] == 40 and "bad.fits" in out["a"]["reasons"][0] and out["a"]["cover_frac"] > 0.9
    got = fits.load_frame(out["a"]["file"])
    cube_, _, header, report = solver.coadd([r[1] for r in rows if r[0] == "a"])
    assert np.allclose(got.data, cube_, atol=1e-3) and got.header["STACKCNT"] == 4 and got.header["TOTALEXP"] == header["TOTALEXP"] and "CRVAL1" not in got.header
    assert ph.background(got.data[1])[1] < 8 / 1.6
    assert [h.name for h in fits.scan_file(out["a"]["file"])] == ["", "WEIGHT"]


def test_frame_sources_and_the_data_source(spark, tmp_path):
    t = truth()
    data = cube(t)
    write(tmp_path / "B.fits", [("", data)])
    write(tmp_path / "a.fit", [("", None), ("RED", data[0]), ("GREEN", data[1]), ("BLUE", data[2]), ("STAR-TAB", {"x": np.arange(3.0), "y": np.ones(3), "flux": np.ones(3)})])
    (tmp_path / "broken.fits").write_bytes(b"SIMPLE  =" + b" " * 100)
    source = frames.FolderSource((str(tmp_path),))
    assert [k.rpartition("/")[2] for k in source.keys()] == ["a.fit", "B.fits", "broken.fits"]
    given = frames.ListSource((("one", str(tmp_path / "B.fits")),))
    p = Project(Target("x", *CENTRE), [], str(tmp_path / "w"), frame_source=given)
    assert [tuple(r)[:2] for r in p.frames(spark).collect()] == [("one", str(tmp_path / "B.fits"))]
    with pytest.raises(ValueError):
        frames.frames_of(spark, frames.ListSource((("k", "a"), ("k", "b"))))
    frames.register(spark)
    heads = {r["path"].rpartition("/")[2]: r for r in spark.read.format("frames").option("path", str(tmp_path)).load().collect()}
    assert heads["B.fits"]["layout"] == "cube" and heads["a.fit"]["ny"] == NY and heads["broken.fits"]["status"] == "failed"
    assert heads["B.fits"]["header"]["OBJECT"] == "MW Cam"
    listed = fits.read_headers(fits.list_frames(spark, f"file://{tmp_path}", curate=lambda path: "broken" not in path))
    assert {r["status"] for r in listed.collect()} == {"ok"} and listed.count() == 2
    table = spark.read.format("frames").option("path", str(tmp_path)).option("pattern", "a.fit").option("hdu", "STAR-TAB").load()
    assert [r["x"] for r in table.collect()] == [0, 1, 2]
    assert fits.read_star_tables(fits.list_frames(spark, f"file://{tmp_path}", curate=F.col("path").contains("a.fit"))).count() == 3
    pixels = spark.read.format("frames").option("path", str(tmp_path)).option("pattern", "B.fits").option("hdu", "pixels").load().where("band = 'G'").first()
    assert np.array_equal(np.frombuffer(pixels["data"], "<f4").reshape(NY, NX), data[1])
    new = spark.createDataFrame([("new.fits", {"OBJECT": "X", "EXPTIME": "10.0", "EQMODE": "0"}, NY, NX, bytearray(data.astype("<f4").tobytes()))], "name string, header map<string,string>, ny int, nx int, planes binary")
    new.write.format("frames").mode("append").option("path", str(tmp_path / "out")).save()
    back = fits.load_frame(str(tmp_path / "out" / "new.fits"))
    assert np.array_equal(back.data, data) and back.header["EXPTIME"] == 10.0 and back.header["OBJECT"] == "X"


def test_headers_are_read_without_pixels(tmp_path, monkeypatch):
    path = write(tmp_path / "a.fits", [("", cube(truth()))])
    read = []
    real = fits.open_file

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read(self, n=-1):
            got = self.f.read(n)
            read.append(len(got))
            return got

    monkeypatch.setattr(fits, "open_file", lambda p: Counting(real(p)))
    assert fits.header_row(path)[1] == "ok" and sum(read) <= 4 * fits.BLOCK
    (tmp_path / "cut.fits").write_bytes((tmp_path / "a.fits").read_bytes()[:100_000])
    assert "truncated" in fits.header_row(str(tmp_path / "cut.fits"))[2]


def test_sidecars(tmp_path):
    assert solver.sidecar_path("/x/a.fits.gz") == "/x/a.wcs" and solver.sidecar_path("/x/a.fit.fz", "/y") == "/y/a.wcs"
    path = str(tmp_path / "a.wcs")
    assert solver.load_sidecar(path) is None
    solver.write_sidecar(path, wcs())
    assert np.allclose(solver.load_sidecar(path).cd, wcs().cd)
    with pytest.raises(ValueError):
        solver.write_sidecar(path, solver.Wcs((1, 1), (2, 2), np.zeros((2, 2))))
    (tmp_path / "flat.wcs").write_bytes(fits.write_fits([("", None)], {"CTYPE1": "LINEAR"}))
    assert solver.load_sidecar(str(tmp_path / "flat.wcs")) is None


def test_ecsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a b", True), (2, None, 'q "x"', None)], "id long, v double, name string, ok boolean")
    ecsv.write_ecsv(df, str(tmp_path / "t.ecsv"))
    got = ecsv.read_ecsv(spark, f"file://{tmp_path}/t.ecsv")
    assert dict(got.dtypes) == {"id": "bigint", "v": "double", "name": "string", "ok": "boolean"} and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "u.ecsv").write_text("# %ECSV 1.0\n# ---\n# delimiter: ','\n# datatype:\n# - name: id\n#   unit: mag\n#   datatype: int64\n# - {name: x, unit: deg, datatype: float32}\nid,x\n3,1.5\n")
    with pytest.raises(ValueError):
        ecsv.read_ecsv(spark, f"file://{tmp_path}/none.ecsv") if (tmp_path / "none.ecsv").write_text("a b\n1 2\n") else None
    assert ecsv.columns_of(["# - {name: x, unit: deg, datatype: float32}"])[0] == {"x": "float"}
    assert ecsv.columns_of(["# delimiter: ','", "# - name: id", "#   unit: mag", "#   datatype: int64"]) == ({"id": "bigint"}, ",")


def test_archives(spark, tmp_path):
    t = truth()
    frame = fits.Frame("f", cube(t), dict(HEADER), "cube")
    raw, moved = archive.cut(frame, 100, (200.0, 150.0), wcs())
    assert fits.read_hdus(raw)[0].data.shape == (3, 100, 100)
    x, y = moved.to_pixel(*wcs().to_world(np.array([200.0]), np.array([150.0])))
    assert abs(x[0] - 50) < 1e-6 and abs(y[0] - 50) < 1e-6
    assert archive.centre_slice((NY, NX), (0.0, 0.0), 50) == (slice(0, 50), slice(0, 50)) and archive.centre_slice((30, 30), (5.0, 5.0), 50)[0] == slice(0, 30)
    mef = archive.cut(fits.Frame("m", cube(t), dict(HEADER), "mef"), 60)[0]
    assert fits.layout_of(fits.read_hdus(mef)) == "mef"
    bx, by = archive.brightest_pixel(frame.plane("G"))
    assert frame.plane("G")[by, bx] == frame.plane("G").max()
    digest = archive.pack({"a.fits": raw, "b.txt": b"x"}, str(tmp_path / "a.tar.gz"))
    assert digest == hashlib.sha256((tmp_path / "a.tar.gz").read_bytes()).hexdigest() == archive.pack({"b.txt": b"x", "a.fits": raw}, str(tmp_path / "b.tar.gz"))


def footprints(spark, rows):
    return spark.createDataFrame([(p, NY, NX, float(w.crpix[0]), float(w.crpix[1]), float(w.crval[0]), float(w.crval[1]), *map(float, w.cd.ravel())) for p, w in rows], "path string, ny int, nx int, crpix1 double, crpix2 double, crval1 double, crval2 double, cd11 double, cd12 double, cd21 double, cd22 double")


def test_footprints_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    turn = np.radians(30)
    spots = [("polar", (10.0, 89.7), 0.02), ("wrap", (359.9, -5.0), 0.01), ("wide", (120.0, 40.0), 0.05)]
    solutions = [(n, solver.Wcs((50.0, 350.0), c, s * np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]]))) for n, c, s in spots]
    z = rng.uniform(-1, 1, 6000)
    ra, dec = rng.uniform(0, 360, 6000), np.degrees(np.arcsin(z))
    ra[:1500], dec[:1500] = (359.9 + rng.uniform(-6, 6, 1500)) % 360, -5 + rng.uniform(-6, 6, 1500)
    ra[1500:3000], dec[1500:3000] = rng.uniform(0, 360, 1500), rng.uniform(83, 90, 1500)
    cat = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))], "source_id long, ra double, dec double")
    got = {(r["path"], r["source_id"]) for r in stages.sources_in_frames(cat, footprints(spark, solutions), 3.0).collect()}
    want = set()
    for name, w in solutions:
        x, y = w.to_pixel(ra, dec)
        want |= {(name, int(i)) for i in np.flatnonzero((x >= -3) & (x < NX + 3) & (y >= -3) & (y < NY + 3))}
    assert got == want and len({p for p, _ in want}) == 3
    assert {r["source_id"] for r in archive.trim(cat, footprints(spark, solutions), 3.0).collect()} == {i for _, i in want}


def test_pixels_of_positions(spark):
    ra, dec = sky.pixel_centres()
    rows = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))]
    assert [r[0] for r in sky.with_pixel(spark.createDataFrame(rows, "i int, ra double, dec double"), "p").orderBy("i").select("p").collect()] == list(range(12288))


def test_far_matches_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    a, c = ((rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))) for n in (60, 7))
    det = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(*a))] + [(99, None, 1.0)], "k long, ra double, dec double")
    cat = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(*c))], "source_id long, ra double, dec double")
    got = {r["k"]: r["sep_arcsec"] for r in match.crossmatch(det, cat, "k").collect()}
    for i, (x, y) in enumerate(zip(*a)):
        assert abs(got[i] - sky.separation(x, y, *c).min() * 3600) < 1e-4
    assert got[99] is None and match.crossmatch(det, cat.where("false"), "k").where("sep_arcsec IS NOT NULL").count() == 0


def test_places_in_an_order(spark):
    rng = np.random.default_rng(6)
    x = rng.permutation(500)
    df = spark.createDataFrame([(int(v),) for v in x], "v int").repartition(7)
    assert {r["v"]: r["at"] for r in solve.numbered(df, "at", "v").collect()} == {i: i for i in range(500)}
    assert sorted(r["v"] for r in solve.strided(df, "v", 60).collect()) == list(range(0, 500, 9))


def test_parts_are_verified_and_staged(spark, tmp_path):
    ra, dec = sky.pixel_centres()
    rows = [((p << 49) + i, float(ra[p]), float(dec[p]), 10.0) for i, p in enumerate((5, 5, 900, 12000))]
    path = f"file://{tmp_path}/ds"
    catalogue.write_dataset(spark.createDataFrame(rows, "source_id long, ra double, dec double, v_jkc_mag double"), path)
    assert catalogue.verify_parts(spark, path) == []
    catalogue.write_part(spark.createDataFrame(rows[2:3], "source_id long, ra double, dec double, v_jkc_mag double"), path, 900)
    spark.createDataFrame([((7 << 49) + 1, 1.0, 1.0)], "source_id long, ra double, dec double").write.parquet(f"{path}/hpx5=7")
    assert catalogue.verify_parts(spark, path) in ([7], [7, 900])
    (tmp_path / "bulk.csv").write_text("# a\n# b\nsource_id,ra,x\n1,2.5,null\n2,3.5,7\n")
    columns = {"source_id": "bigint", "ra": "double"}
    assert catalogue.stage_bulk(spark, f"file://{tmp_path}/bulk.csv", f"file://{tmp_path}/staged", columns) and not catalogue.stage_bulk(spark, f"file://{tmp_path}/bulk.csv", f"file://{tmp_path}/staged", columns)
    assert catalogue.staged(spark, f"file://{tmp_path}/staged", columns).count() == 2
    small = catalogue.unique(catalogue.stacked([spark.createDataFrame([(1, 5), (2, 6)], "source_id int, v int"), spark.createDataFrame([(1, 4)], "source_id int, v int")]))
    assert {tuple(r) for r in small.collect()} == {(1, 4), (2, 6)}


def test_apertures_equal_plain_sums():
    rng = np.random.default_rng(2)
    data = rng.normal(10, 3, (60, 80))
    mask = rng.random((60, 80)) < 0.05
    x, y, r = rng.uniform(-4, 84, 40), rng.uniform(-4, 64, 40), rng.uniform(1.5, 7, 40)
    x[3] = np.nan
    flux, err, flag = ph.sum_circle(data, x, y, r, 2.0, mask, (9.0, 12.0))
    gy, gx = np.mgrid[:60, :80]
    for i in range(40):
        if not np.isfinite(x[i]):
            assert np.isnan(flux[i]) and flag[i] == ph.FLAG_EDGE
            continue
        w = ph.circle_weights(gx - x[i], gy - y[i], r[i]).astype(float)
        whole, hidden = w.sum(), mask & (w > 0)
        w[hidden] = 0
        if hidden.any() and w.sum() > 0:
            w *= whole / w.sum()
        ring = ph.circle_weights(gx - x[i], gy - y[i], 12.0).astype(float) - ph.circle_weights(gx - x[i], gy - y[i], 9.0)
        want = (w * data).sum() - (ring * data).sum() / max(ring.sum(), 1e-9) * w.sum()
        assert abs(flux[i] - want) < 1e-2 and bool(flag[i] & ph.FLAG_MASKED) == bool(hidden.any())
    assert np.isnan(ph.max_in_aperture(data, np.array([-50.0]), np.array([5.0]), 3.0)[0])
    got = ph.max_in_aperture(data, np.array([20.2]), np.array([30.4]), 3.0)[0]
    assert got == data[(gx - 20) ** 2 + (gy - 30) ** 2 <= 9].max()


def test_sky_masks_and_mosaic_figures():
    from starlode.pixels import mosaic

    ra, dec = wcs().to_world(np.array([100.0]), np.array([120.0]))
    mask = ph.mask_of([(float(ra[0]), float(dec[0]), 30.0), (float("nan"), 0.0, 30.0)])(fits.Frame("f", np.zeros((3, NY, NX), np.float32), {}, "cube"), wcs())
    assert mask[120, 100] and not mask[120, 130] and abs(mask.sum() - math.pi * (30 / 2.39) ** 2) < 30
    assert not ph.mask_of([])(fits.Frame("f", np.zeros((3, 9, 9), np.float32), {}, "cube"), wcs()).any()
    raw = np.zeros((6, 8), np.float32)
    for i, c in enumerate("RGGB"):
        raw[i // 2 :: 2, i % 2 :: 2] = {"R": 1, "G": 2, "B": 3}[c]
    assert mosaic.channel_medians(raw, "RGGB").tolist() == [1, 2, 3] and (mosaic.green_half(raw, "RGGB") == 2).all()


def test_example_folders(spark, tmp_path):
    t = truth()
    write(tmp_path / "stack_a.fits", [("", cube(t))], HEADER | wcs().to_header())
    write(tmp_path / "sub_1.fits", [("", cube(t, 8))])
    ecsv.write_ecsv(spark.createDataFrame(catalogue_rows(t), CATALOGUE), str(tmp_path / "catalogue.ecsv"))
    data = examples.Examples(str(tmp_path))
    assert data.is_there() and data.available("stack") == ["stack_a"] and len(data.sub_paths()) == 1 and data.frame("stack").layout == "cube"
    assert np.allclose(data.wcs("stack_a").cd, wcs().cd) and data.wcs("sub_1") is None and data.catalogue(spark).count() == 49
    solver.write_sidecar(solver.sidecar_path(data.path("sub_1")), wcs())
    assert data.wcs("sub_1") is not None
    with pytest.raises(KeyError, match="stack_a"):
        data.path("none")
    p = data.project(Target("MW Cam", *CENTRE), str(tmp_path / "w"), solver="lift")
    assert p.frames(spark).count() == 2
    df = spark.createDataFrame([(1, {"OBJECT": "MW Cam"}), (2, {"OBJECT": "Other"}), (3, {})], "i int, header map<string,string>")
    assert sorted(r["i"] for r in examples.only_object(df, "mw cam").collect()) == [1, 3]


def test_a_transit_is_found_in_its_fold(spark):
    t = np.linspace(0, 9, 700)
    dip = np.where(np.abs((t - 1.0 + 1.0) % 2.0 - 1.0) < 0.05, 0.02, 0.0)
    lc = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, dip)], "time double, dmag double")
    got = examples.transit(lc, 1.0, 2.0, 0.1)
    assert abs(got["depth"].first()["depth"] - 0.02) < 2e-3 and got["bins"].count() == 50


def test_headers_without_a_site_have_no_airmass(spark):
    df = spark.createDataFrame([({"DATE-OBS": "2026-07-24T21:00:00", "RA": "10", "DEC": "20"},)], "header map<string,string>")
    assert df.select(headers.frame_times()["airmass"]).first()[0] is None
