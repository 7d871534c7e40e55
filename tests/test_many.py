"""Light curves of many targets, long series, streams and a project's catalogue."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from starlode.operators import ensemble, period, solve
from starlode.plans import stages
from starlode.plans.project import Project, Target
from starlode.sources import catalogue
from starlode.streaming import incremental


def test_many_lightcurves_equal_one_by_one(spark):
    rng = np.random.default_rng(4)
    rows = [(s, f"f{f:02}", "G", float(f), 1.0, 12 + 0.1 * s + float(rng.normal(0, 0.01)), 0.01, 0, True) for f in range(12) for s in range(1, 10) if (f, s) != (3, 2)]
    meas = spark.createDataFrame(rows, "source_id int, frame string, band string, bjd_tdb double, airmass double, m_inst double, mag_err double, flag int, on_chip boolean")
    comps = spark.createDataFrame([(s, 12 + 0.1 * s) for s in range(5, 10)], "source_id int, v_jkc_mag double")
    targets = spark.createDataFrame([(1,), (2,), (2,), (77,)], "source_id int")
    many = ensemble.lightcurves(meas, targets, comps)
    assert many.select("source_id").distinct().count() == 2
    for s, n in ((1, 12), (2, 11)):
        one = ensemble.differential_lightcurve(meas, s, comps)
        mine, other = many.where(F.col("source_id") == s).orderBy("time").collect(), one.collect()
        assert [r["frame"] for r in mine] == [r["frame"] for r in other] and len(mine) == n
        # Sums over rows in another order differ in their last digits.
        assert all(np.allclose([a[c] for c in ("time", "mag", "mag_err", "zp_ens", "zp_scatter", "n_comp", "dmag")], [b[c] for c in ("time", "mag", "mag_err", "zp_ens", "zp_scatter", "n_comp", "dmag")], atol=1e-9) for a, b in zip(mine, other))


def test_running_median_of_one_series(spark):
    x = np.random.default_rng(5).permutation(103).astype(float)
    got = period.running_median(spark.createDataFrame([(float(v), 2 * float(v)) for v in x], "x double, y double").repartition(5), "x", "y").orderBy("tile").collect()
    tiles = np.array_split(np.sort(x), 5)
    assert [(r["x"], r["y"], r["n"]) for r in got] == [(np.median(t), 2 * np.median(t), len(t)) for t in tiles]
    assert period.running_median(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), "x", "y").count() == 0


def test_places_do_not_depend_on_how_small_ranges_are_joined(spark):
    # AQE joined the ranges in one way for their sizes and in another for their rows.
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    n = 40_000
    df = spark.range(0, n, 1, 7).select((F.col("id") * 7919 % n).cast("double").alias("x")).withColumn("y", -F.col("x"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = period.running_median(df, "x", "y").orderBy("tile").collect()
        strided = solve.strided(df, "x", 60).collect()
        ranks = solve.brightness_rank(df.select(F.col("x").alias("v_mag"), F.col("x").cast("long").alias("source_id"), F.lit(None).alias("unknown"))).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [(r["tile"], r["x"], r["y"], r["n"]) for r in got] == [(i + 1, 20 * i + 9.5, -20 * i - 9.5, 20) for i in range(n // 20)]
    assert sorted(r["x"] for r in strided) == list(range(0, n, 667))
    assert sorted((r["rank"], r["source_id"], r["unknown"]) for r in ranks) == [(i + 1, i, None) for i in range(n)]


def test_late_rows_of_a_stream_are_left(spark, tmp_path):
    day = lambda n: datetime.datetime(2026, 7, n, 12)
    for name, rows in (("a", [(day(1), "G", 21.0), (day(1), "G", 23.0), (day(2), "R", 20.0)]), ("b", [(day(10), "G", 22.0)]), ("then", [(day(10), "R", 19.0)]), ("c", [(day(1), "G", 99.0), (day(9), "G", 24.0)]), ("d", [(day(20), "G", 1.0)])):
        spark.createDataFrame(rows, "ts timestamp, band string, zp double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, band string, zp double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.windowed_zeropoints(stream).writeStream.format("memory").queryName("zeropoints").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "log")).start()
    query.awaitTermination()
    got = {(r["start"].day, r["band"]): (r["n"], r["zp"]) for r in spark.table("zeropoints").collect()}
    # A watermark tells late rows from the second run on after the row that moved it.
    assert got == {(1, "G"): (2, 22.0), (2, "R"): (1, 20.0), (9, "G"): (1, 24.0), (10, "G"): (1, 22.0), (10, "R"): (1, 19.0)}


def test_a_projects_catalogue_comes_from_the_dataset_that_covers_it(spark, tmp_path):
    rng = np.random.default_rng(3)
    from starlode.functions import sky

    p = spark.createDataFrame([(i, float(120 + x), float(10 + y), float(g)) for i, (x, y, g) in enumerate(zip(rng.uniform(-3, 3, 400), rng.uniform(-3, 3, 400), rng.uniform(9, 19, 400)))], "i long, ra double, dec double, phot_g_mean_mag double")
    rows = sky.with_pixel(p, "pixel").withColumn("source_id", F.shiftleft(F.col("pixel").cast("long"), 49) + F.col("i")).drop("pixel", "i")
    path = f"file://{tmp_path}/ds"
    catalogue.write_dataset(rows, path)
    fetched = lambda s, ra, dec, r: rows.limit(3)
    near = Project(Target("x", 120.0, 10.0), [], f"file://{tmp_path}/a", half_size_deg=0.5, gmag_limit=17.0, catalogue_dataset=path, fetch=fetched)
    far = Project(Target("x", 300.0, -60.0), [], f"file://{tmp_path}/b", half_size_deg=0.5, catalogue_dataset=path, fetch=fetched)
    assert near.catalogue_backend_used(spark) == "local" and far.catalogue_backend_used(spark) == "fetch"
    r = near.catalogue_radius_deg
    want = [x for x in rows.collect() if sky.separation(120.0, 10.0, x["ra"], x["dec"]) <= r and x["phot_g_mean_mag"] < 17]
    assert near.catalogue(spark).count() == len(want) > 0 and far.catalogue(spark).count() == 3
    rows.limit(1).write.mode("overwrite").parquet(near.catalogue_path)
    assert near.catalogue(spark).count() == 1 and near.catalogue(spark, overwrite=True).count() == len(want)
    assert near.slug == "x" and Project(Target("V* AB", 1, 2), [], "w").slug == "v__ab"
    arrays = stages.catalogue_arrays(near, spark)
    assert len(arrays["source_id"]) == len(want) and (np.diff(arrays["source_id"]) > 0).all() and np.isnan(arrays["mag"]).all()
