"""Period search, phase folding and binned summaries of series."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import is_finite, phase_fold
from .solve import numbered


#: Points of the longest series that goes to the tasks (16 bytes each).
MOST_POINTS = 4_000_000


def periodogram(lc: DataFrame, min_period: float = 0.01, max_period: float | None = None, samples_per_peak: int = 10, mag_col: str = "dmag") -> DataFrame:
    """(frequency, period, power): the floating-mean Lomb-Scargle power of one series on a regular grid; NULL where it is undefined.

    Only finite points count; below five, or over MOST_POINTS, ValueError. The light curve
    is evaluated once and its points go to the tasks, each of which works out its own
    frequencies, so nothing is shuffled. Without max_period it is the baseline.
    """
    points = lc.where(is_finite("time") & is_finite(mag_col)).select(F.col("time").cast("double").alias("t"), F.col(mag_col).cast("double").alias("y"))
    rows = points.limit(MOST_POINTS + 1).toArrow()
    n = rows.num_rows
    if n < 5:
        raise ValueError(f"a periodogram needs at least 5 points, got {n}")
    if n > MOST_POINTS:
        raise ValueError(f"over {MOST_POINTS} points; bin the series first")
    t, y = rows["t"].to_numpy(), rows["y"].to_numpy()
    order = np.lexsort((y, t))
    t, y = t[order] - t.min(), y[order]
    base = float(t[-1])
    if base <= 0:
        raise ValueError("all points have one time")
    low, high = 1.0 / (max_period or base), 1.0 / min_period
    step = 1.0 / (base * samples_per_peak)
    count = 1 + int(round((high - low) / step))
    spark = lc.sparkSession
    shared = spark.sparkContext.broadcast((t, y))

    def run(batches):
        t, y = shared.value
        size = max(1, 2_000_000 // len(t))
        for batch in batches:
            f = low + batch.column(0).to_numpy() * step
            power = np.concatenate([lomb_scargle(f[i : i + size], t, y) for i in range(0, len(f), size)])
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(1.0 / f), pa.array(power, mask=np.isnan(power))], ["frequency", "period", "power"])

    tasks = max(1, min(count // 256, spark.sparkContext.defaultParallelism * 4))
    return spark.range(0, count, 1, tasks).mapInArrow(run, "frequency double, period double, power double")


def lomb_scargle(frequency: np.ndarray, t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The floating-mean power at each frequency; NaN where it is undefined."""
    angle = 2 * np.pi * frequency[:, None] * t
    c, s = np.cos(angle), np.sin(angle)
    mc, ms, my = c.mean(1), s.mean(1), y.mean()
    yy, yc, ys = (y * y).mean() - my * my, (c * y).mean(1) - my * mc, (s * y).mean(1) - my * ms
    cc, ss, cs = (c * c).mean(1) - mc * mc, (s * s).mean(1) - ms * ms, (c * s).mean(1) - mc * ms
    den = yy * (cc * ss - cs * cs)
    return np.where(den > 1e-300, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / np.where(den > 1e-300, den, 1), np.nan)


def best_period(pg: DataFrame) -> DataFrame:
    """The row of the highest power, the lowest frequency of equals."""
    return pg.where("power IS NOT NULL").orderBy(F.desc("power"), "frequency").limit(1)


def false_alarm(z: float, n: int, f_max: float, var_t: float) -> float:
    """The false-alarm probability of a standard-normalised peak (Baluev 2008)."""
    if n < 4 or z >= 1:
        return 0.0 if z >= 1 else 1.0
    gamma = math.sqrt(2 / (n - 1)) * math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2))
    tau = gamma * f_max * math.sqrt(4 * math.pi * var_t) * (1 - z) ** ((n - 4) / 2) * math.sqrt((n - 1) * z / 2)
    return 1 - (1 - (1 - z) ** ((n - 3) / 2)) * math.exp(-tau)


def search(lc: DataFrame, **kwargs) -> dict:
    """best_period, power, fap and n of a light curve."""
    mag = kwargs.get("mag_col", "dmag")
    top = best_period(periodogram(lc, **kwargs)).first()
    n, var = lc.where(is_finite("time") & is_finite(mag)).agg(F.count("*"), F.var_pop("time")).first()
    return {"best_period": top["period"], "power": top["power"], "fap": false_alarm(top["power"], n, 1.0 / kwargs.get("min_period", 0.01), var), "n": n}


def fold(lc: DataFrame, period: float, t0: float | None = None) -> DataFrame:
    """``lc`` with ``phase`` in [0, 1); t0 is the first finite time unless given."""
    if t0 is None:
        t0 = lc.where(is_finite("time")).agg(F.min("time")).first()[0] or 0.0
    return lc.withColumn("phase", phase_fold("time", period, t0))


def phase_bins(folded: DataFrame, n_bins: int = 25, mag_col: str = "dmag") -> DataFrame:
    """(phase, mean, n) of each filled bin."""
    rows = folded.where(is_finite(mag_col)).withColumn("bin", F.least(F.floor(F.col("phase") * n_bins), F.lit(n_bins - 1)))
    return rows.groupBy("bin").agg(F.avg(mag_col).alias("mean"), F.count("*").alias("n")).select(((F.col("bin") + 0.5) / n_bins).alias("phase"), "mean", "n").orderBy("phase")


def running_median(points: DataFrame, x: str, y: str, keys: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """(keys, tile, x, y, n): medians of equal-count bins along x, max(n // 20, 4) of them, for series of over 20 points."""
    rows = points.where(is_finite(x) & is_finite(y))
    if keys:
        w = W.partitionBy(*keys)
        rows = rows.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy(x, y, *order)) - 1)
    else:
        rows = numbered(rows.select(*dict.fromkeys((x, y, *order))), "__i", x, y, *order, total="__n")
    rows = rows.where("__n > 20")
    tiles = F.greatest(F.floor(F.col("__n") / 20), F.lit(4))
    big, size = F.col("__n") % tiles, F.floor(F.col("__n") / tiles)
    # The first n % k tiles hold one more, as with NTILE.
    tile = F.when(F.col("__i") < big * (size + 1), F.floor(F.col("__i") / (size + 1))).otherwise(big + F.floor((F.col("__i") - big * (size + 1)) / size))
    return rows.withColumn("tile", tile + 1).groupBy(*keys, "tile").agg(F.median(x).alias("x"), F.median(y).alias("y"), F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 40, log: bool = False, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(bin, lo, hi, n) of the filled bins between the extremes (or bounds), linear or in powers; the last bin holds its upper end."""
    v = F.col(column)
    rows = df.where(is_finite(column) & ((v > 0) if log else F.lit(True))).select((F.log10(v) if log else v).alias("v"))
    ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b")) if bounds is None else df.sparkSession.range(1).select(F.lit(float(bounds[0])).alias("a"), F.lit(float(bounds[1])).alias("b"))
    rows = rows.join(F.broadcast(ends)).where("v BETWEEN a AND b")
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1))).otherwise(0)
    out = rows.groupBy(at.alias("bin"), "a", "b").agg(F.count("*").alias("n"))
    lo, hi = F.col("a") + F.col("bin") * width, F.col("a") + (F.col("bin") + 1) * width
    return out.select("bin", (F.pow(F.lit(10.0), lo) if log else lo).alias("lo"), (F.pow(F.lit(10.0), hi) if log else hi).alias("hi"), "n").orderBy("bin")


def relative_time(df: DataFrame, column: str = "time") -> DataFrame:
    """``df`` with time since the whole day of its first finite time."""
    start = df.where(is_finite(column)).agg(F.floor(F.min(column)).alias("__t"))
    return df.join(F.broadcast(start), how="cross").withColumn("rel_time", F.col(column) - F.col("__t")).drop("__t")
