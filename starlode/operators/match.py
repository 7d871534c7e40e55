"""Cross-matching on the sky and in pixels, through grids of cells instead of all pairs."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from ..functions.sky import HPX_MAX_RADIUS, pixel_centres, separation_deg, unit_vector, with_pixel


def _cells(df: DataFrame, ra: str, dec: str, size: float, spread: bool) -> DataFrame:
    """Adds the cell (cx, cy, cz) of a point's unit vector, with ``spread`` all 27 around it: no pole and no wrap is special."""
    x, y, z = unit_vector(ra, dec)
    df = df.withColumn("cx", F.floor(x / size)).withColumn("cy", F.floor(y / size)).withColumn("cz", F.floor(z / size))
    if spread:
        near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        for c in ("cx", "cy", "cz"):
            df = df.withColumn("__d", F.explode(near)).withColumn(c, F.col(c) + F.col("__d")).drop("__d")
    return df


def near_pairs(left: DataFrame, right: DataFrame, radius_deg: float, left_pos=("ra", "dec"), right_pos=("cat_ra", "cat_dec")) -> DataFrame:
    """All pairs within a radius and their ``sep_arcsec``. Columns of the two sides must differ in name."""
    size = 2 * math.sin(math.radians(radius_deg) / 2) + 1e-12
    a, b = _cells(left, *left_pos, size, False), _cells(right, *right_pos, size, True)
    sep = separation_deg(F.col(left_pos[0]), F.col(left_pos[1]), F.col(right_pos[0]), F.col(right_pos[1])) * 3600.0
    return a.join(b, ["cx", "cy", "cz"]).drop("cx", "cy", "cz").withColumn("sep_arcsec", sep).where(F.col("sep_arcsec") <= radius_deg * 3600.0)


def nearest_far(rest: DataFrame, cat: DataFrame, best) -> DataFrame:
    """(__key, best) of rows (__key, ra, dec) whose nearest catalogue row may be anywhere.

    Level-5 pixels with catalogue rows compare with those of the rows by their centres; a
    pixel that lies farther than the nearest one by more than both pixels' reach can't hold
    the nearest row. At most 12288 pixels meet as many, and rows only those of the pixels left.
    """
    spark = rest.sparkSession
    ra, dec = pixel_centres()
    table = pa.table({"__q": pa.array(range(len(ra)), pa.int32()), "__qra": ra, "__qdec": dec})
    centres = F.broadcast(spark.createDataFrame(table))
    rest, cat = with_pixel(rest, "__p"), with_pixel(cat, "__q", "cat_ra", "cat_dec")
    from_ = rest.select("__p").distinct().join(centres.select(F.col("__q").alias("__p"), F.col("__qra").alias("__pra"), F.col("__qdec").alias("__pdec")), "__p")
    to = F.broadcast(cat.select("__q").distinct().join(centres, "__q"))
    apart = from_.join(to, how="cross").withColumn("__d", separation_deg(F.col("__pra"), F.col("__pdec"), F.col("__qra"), F.col("__qdec")))
    least = F.min("__d").over(W.partitionBy("__p"))
    likely = apart.withColumn("__least", least).where(F.col("__d") <= F.col("__least") + 4 * HPX_MAX_RADIUS).select("__p", "__q")
    sep = separation_deg(F.col("ra"), F.col("dec"), F.col("cat_ra"), F.col("cat_dec")) * 3600.0
    return rest.join(likely, "__p").join(cat, "__q").withColumn("sep_arcsec", sep).groupBy("__key").agg(best)


def crossmatch(sources: DataFrame, catalogue: DataFrame, key: str, tol_arcsec: float = 2.0, columns: tuple[str, ...] | None = None, id_col: str = "source_id", radii_deg=(0.01, 0.3)) -> DataFrame:
    """Every source with its nearest catalogue row: sep_arcsec always, the row's columns only within the tolerance (strictly).

    Catalogue positions come as cat_ra and cat_dec, its id as ``id_col``. Sources without a
    neighbour in the first radius look in the next wider cells, and what is left after the
    last one (as of frames with a wrong solution) looks by pixels; ties go to the smaller
    id. With an empty catalogue sep_arcsec is NULL.
    """
    columns = columns if columns is not None else tuple(c for c in catalogue.columns if c not in ("ra", "dec"))
    cat = catalogue.select(F.col("ra").alias("cat_ra"), F.col("dec").alias("cat_dec"), *[F.col(c).alias(f"__{c}") for c in dict.fromkeys((id_col, *columns))])
    left = sources.select(F.col(key).alias("__key"), "ra", "dec").where(is_finite("ra") & is_finite("dec"))
    best = F.min_by(F.struct("sep_arcsec", "cat_ra", "cat_dec", *[f"__{c}" for c in dict.fromkeys((id_col, *columns))]), F.struct("sep_arcsec", f"__{id_col}")).alias("best")
    found, rest = None, left
    for radius in radii_deg:
        got = near_pairs(rest, cat, radius).groupBy("__key").agg(best)
        found = got if found is None else found.unionByName(got)
        rest = rest.join(got.select("__key"), "__key", "left_anti")
    far = nearest_far(rest, cat, best)
    found = far if found is None else found.unionByName(far)
    out = sources.join(found, sources[key] == found["__key"], "left").drop("__key")
    hit = F.col("best.sep_arcsec") < tol_arcsec
    extra = [F.when(hit, F.col(f"best.__{c}")).alias(c) for c in columns if c not in sources.columns]
    return out.select(*sources.columns, F.col("best.sep_arcsec").alias("sep_arcsec"), F.when(hit, F.col("best.cat_ra")).alias("cat_ra"), F.when(hit, F.col("best.cat_dec")).alias("cat_dec"), *extra)


def match_quality(sources: DataFrame, tol_arcsec: float = 2.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """sep_median, sep_p90, matched_frac and n of the finite separations; without any: NULL, NULL, 0, 0."""
    sep = F.when(is_finite("sep_arcsec"), F.col("sep_arcsec"))
    p = F.percentile(sep, F.array(F.lit(0.5), F.lit(0.9)))
    rows = sources.groupBy(*keys).agg(p.alias("p"), F.coalesce(F.avg((sep < tol_arcsec).cast("double")), F.lit(0.0)).alias("matched_frac"), F.count(sep).alias("n"))
    return rows.select(*keys, F.col("p")[0].alias("sep_median"), F.col("p")[1].alias("sep_p90"), "matched_frac", "n")


def _grid(df: DataFrame, x: str, y: str, size: float, spread: bool) -> DataFrame:
    df = df.withColumn("gx", F.floor(F.col(x) / size)).withColumn("gy", F.floor(F.col(y) / size))
    if spread:
        near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        for c in ("gx", "gy"):
            df = df.withColumn("__d", F.explode(near)).withColumn(c, F.col(c) + F.col("__d")).drop("__d")
    return df


def pair_up(detections: DataFrame, catalogue: DataFrame, tol_px: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, det_id, cat_id, dist): for each catalogue row its nearest detection within tol_px, then the nearest such row of each detection.

    Detections are (keys, det_id, x, y), catalogue rows (keys, cat_id, cx, cy); ties go to the smaller id.
    """
    a = _grid(detections, "x", "y", tol_px, False)
    b = _grid(catalogue, "cx", "cy", tol_px, True)
    dist = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    near = a.join(b, [*keys, "gx", "gy"]).withColumn("dist", dist).where(F.col("dist") <= tol_px)
    one = near.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "cat_id").orderBy("dist", "det_id"))).where("__r = 1")
    two = one.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "det_id").orderBy("dist", "cat_id"))).where("__r = 1")
    return two.select(*keys, "det_id", "cat_id", "dist")


def nearest_neighbour(points: DataFrame, radius: float, key: str = "id", x: str = "x", y: str = "y", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, key, nn_dist): the distance to the nearest other point within ``radius``, NULL if there is none."""
    a = _grid(points.select(*keys, key, x, y), x, y, radius, False)
    b = _grid(points.select(*keys, F.col(key).alias("__o"), F.col(x).alias("__x"), F.col(y).alias("__y")), "__x", "__y", radius, True)
    dist = F.sqrt(F.pow(F.col(x) - F.col("__x"), 2) + F.pow(F.col(y) - F.col("__y"), 2))
    near = a.join(b, [*keys, "gx", "gy"]).where(F.col(key) != F.col("__o")).withColumn("d", dist).where(F.col("d") <= radius)
    return points.select(*keys, key).join(near.groupBy(*keys, key).agg(F.min("d").alias("nn_dist")), [*keys, key], "left")


def offset_vote(detections: DataFrame, predicted: DataFrame, half_px: float, bin_px: float = 32.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, votes, dx, dy): the fullest bin of detection minus prediction offsets and the mean offset in it.

    Both sides hold the few hundred brightest rows of a field by contract; ties go to the smaller bin.
    """
    p = predicted.select(*keys, F.col("px"), F.col("py"))
    pairs = detections.select(*keys, "x", "y").join(p, list(keys)) if keys else detections.select("x", "y").crossJoin(F.broadcast(p))
    pairs = pairs.select(*keys, (F.col("x") - F.col("px")).alias("ox"), (F.col("y") - F.col("py")).alias("oy")).where(f"abs(ox) <= {half_px} AND abs(oy) <= {half_px}")
    bins = pairs.groupBy(*keys, F.floor((F.col("ox") + half_px) / bin_px).alias("ix"), F.floor((F.col("oy") + half_px) / bin_px).alias("iy")).agg(F.count("*").alias("votes"), F.avg("ox").alias("dx"), F.avg("oy").alias("dy"))
    first = F.max_by(F.struct("votes", "dx", "dy"), F.struct("votes", -F.col("ix"), -F.col("iy"))).alias("b")
    return bins.groupBy(*keys).agg(first).select(*keys, "b.votes", "b.dx", "b.dy")
