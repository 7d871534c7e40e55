"""Relational parts of plate solving; the per-frame search is in pixels.solver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import kept


def numbered(df: DataFrame, name: str, *order: Column | str, total: str | None = None) -> DataFrame:
    """``df`` with its rows' places (from 0) in an order, and in column ``total`` their number: ranges of it are sorted each in its task, and a range starts where those before it end.

    The sorted ranges are written once. Evaluated twice, for their sizes and for their rows,
    they could end at other rows each time: bounds are sampled and AQE joins small ranges.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    # A row for each range.
    before = F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"), *([F.sum("__size").over(W.partitionBy()).alias(total)] if total else []))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def strided(df: DataFrame, order: str, most: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced in an order: pairs for a fit."""
    if not keys:
        return numbered(df, "__i", order, total="__c").where(F.col("__i") % F.ceil(F.col("__c") / float(most)) == 0).drop("__i", "__c")
    own = W.partitionBy(*keys)
    step = F.ceil(F.count("*").over(own) / float(most))
    return df.withColumn("__k", step).withColumn("__i", F.row_number().over(own.orderBy(order)) - 1).where("__i % __k = 0").drop("__k", "__i")


def brightness_rank(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``rank`` by the first of V, G and BP magnitudes that exists, unknown ones last."""
    column = next(c for c in ("v_jkc_mag", "v_mag", "phot_g_mean_mag", "phot_bp_mean_mag") if c in df.columns)
    known = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
    if not keys:
        return numbered(df, "rank", known.asc_nulls_last(), F.col("source_id").asc()).withColumn("rank", (F.col("rank") + 1).cast("int"))
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(known.asc_nulls_last(), "source_id")))


def brightest(df: DataFrame, most: int, keys: tuple[str, ...], *order: Column | str) -> DataFrame:
    """The first ``most`` rows of each key in an order: detections, core and catalogue stars of a solve."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def tolerance_ladder(start_arcsec: float, target_arcsec: float) -> list[float]:
    """Start, thirds of it down to the target, then a half and a third of the target."""
    out = [start_arcsec]
    while out[-1] / 3 > target_arcsec:
        out.append(out[-1] / 3)
    return [*out, target_arcsec, target_arcsec / 2, target_arcsec / 3]
