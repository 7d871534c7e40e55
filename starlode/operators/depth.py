"""Frame quality and depth: photometric cuts, limits by group, the exposure grid and the condition model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EXPTIME_GRID, EXPTIME_REF, RMS_PHOTOMETRIC, is_finite, scale_limit


def photometric(frames: DataFrame, rms_max: float = RMS_PHOTOMETRIC) -> DataFrame:
    return frames.where(is_finite("rms") & (F.col("rms") < rms_max))


def detection_limit(frames: DataFrame, t_ref: float = EXPTIME_REF, rms_max: float = RMS_PHOTOMETRIC, group: str = "model") -> DataFrame:
    """(group, n, v_lim, v_lim_std): median 5-sigma limit of the photometric frames, brought to one exposure."""
    v = scale_limit("v_lim_5sigma", "total_exptime", t_ref)
    rows = photometric(frames, rms_max).select(group, v.alias("v")).where(is_finite("v"))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.median("v").alias("v_lim"), F.stddev_pop("v").alias("v_lim_std")).orderBy(group)


def limit_vs_exptime(frames: DataFrame, exptimes=EXPTIME_GRID, rms_max: float = RMS_PHOTOMETRIC, group: str = "model") -> DataFrame:
    """detection_limit for each exposure of a grid. The limits shift by a constant, so one aggregate serves the grid."""
    base = detection_limit(frames, EXPTIME_REF, rms_max, group)
    grid = base.withColumn("exptime", F.explode(F.array(*[F.lit(float(t)) for t in exptimes])))
    return grid.select(group, "exptime", "n", (F.col("v_lim") + 1.25 * F.log10(F.col("exptime") / EXPTIME_REF)).alias("v_lim"), "v_lim_std").orderBy(group, "exptime")


def rms_percentiles(frames: DataFrame, limit: float = RMS_PHOTOMETRIC) -> DataFrame:
    rows = frames.where(is_finite("rms"))
    p = rows.agg(F.percentile("rms", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), F.count_if(F.col("rms") < limit).alias("n_photometric"), F.count("*").alias("n"))
    return p.select(F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p90"), "n_photometric", "n")


def aperture_noise(sources: DataFrame, keys: tuple[str, ...] = ("frame",), band: str = "G") -> DataFrame:
    """(keys, sigma_aper): the median flux error of a band's sources."""
    return sources.where(F.col("band") == band).groupBy(*keys).agg(F.median("fluxerr").alias("sigma_aper"))


def fit_depth_model(frames: DataFrame, rms_max: float = RMS_PHOTOMETRIC, keys: tuple[str, ...] = ()) -> DataFrame:
    """v = a + b log10 t + c sky + d fwhm by least squares for each key: a, b, c, d, rms, n.

    The normal equations are sums that Spark makes map-side; only a 4 x 4 system of each
    group is solved in Python. Singular systems have the least-norm solution.
    """
    import pyarrow as pa

    names = ("v_lim_5sigma", "total_exptime", "sky_sb", "fwhm_G")
    rows = photometric(frames, rms_max)
    for c in names:
        rows = rows.where(is_finite(c))
    rows = rows.where("total_exptime > 0").select(*keys, F.lit(1.0).alias("x0"), F.log10("total_exptime").alias("x1"), F.col("sky_sb").alias("x2"), F.col("fwhm_G").alias("x3"), F.col("v_lim_5sigma").alias("y"))
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(4) for j in range(i, 4)]
    sums += [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"t{i}") for i in range(4)] + [F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("y1")]
    moments = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums).where("n > 0")
    fields = [f for f in moments.schema.fields if f.name in keys]

    def solve(batches):
        for batch in batches:
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n not in keys}
            out = []
            for r in range(batch.num_rows):
                a = np.array([[col[f"s{min(i, j)}{max(i, j)}"][r] for j in range(4)] for i in range(4)])
                t = np.array([col[f"t{i}"][r] for i in range(4)])
                beta = np.linalg.lstsq(a, t, rcond=1e-13)[0]
                n = col["n"][r]
                mean = (col["y1"][r] - beta @ a[0]) / n
                out.append([*beta, np.sqrt(max((col["yy"][r] - 2 * beta @ t + beta @ a @ beta) / n - mean**2, 0.0))])
            found = np.array(out).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(found[:, i]) for i in range(5)), batch.column("n")], [*keys, "a", "b", "c", "d", "rms", "n"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in ("a", "b", "c", "d", "rms")), T.StructField("n", T.LongType())])
    return moments.mapInArrow(solve, schema)
