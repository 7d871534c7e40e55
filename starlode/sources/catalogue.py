"""The reference catalogue as a HEALPix-partitioned Parquet dataset: writing, cones, coverage, upserts and the bulk build."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from ..functions import sky
from ..functions.scalar import conform_flag, hpx_of

#: The dataset's columns: fixed names and types.
COLUMNS = {
    "source_id": "bigint", "ra": "double", "dec": "double", "phot_g_mean_mag": "float", "bp_rp": "float", "v_jkc_mag": "float", "b_jkc_mag": "float", "r_jkc_mag": "float",
    "v_jkc_flag": "boolean", "pmra": "float", "pmdec": "float", "c_star": "float", "ruwe": "float", "ipd_frac_multi_peak": "smallint", "duplicated_source": "boolean",
    "in_galaxy_candidates": "boolean", "non_single_star": "smallint", "phot_variable_flag": "string", "teff_gspphot": "float", "has_epoch_photometry": "boolean",
}
KEYS = ("source_id", "ra", "dec")
V_LIMIT = 17.5


def conform(table: DataFrame) -> DataFrame:
    """The dataset's columns and types: absent ones NULL, NaN as NULL, flags from any spelling; an absent key column raises ValueError."""
    missing = [k for k in KEYS if k not in table.columns]
    if missing:
        raise ValueError(f"the catalogue has no {', '.join(missing)}")
    kinds = dict(table.dtypes)
    out = []
    for name, kind in COLUMNS.items():
        if name not in kinds:
            c = F.lit(None).cast(kind)
        elif kind == "boolean" and kinds[name] != "boolean":
            c = F.when(F.col(name).isNotNull(), conform_flag(name))
        elif kinds[name] in ("float", "double"):
            c = F.when(~F.isnan(name), F.col(name)).cast(kind)
        else:
            c = F.col(name).cast(kind)
        out.append(c.alias(name))
    return table.select(*out)


def check_unique(table: DataFrame) -> None:
    """ValueError if an id stands twice."""
    twice = table.groupBy("source_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"source_id {twice[0]['source_id']} stands twice")


def write_dataset(table: DataFrame, path: str, mode: str = "overwrite") -> dict:
    """One folder for each level-5 pixel of the ids, rows sorted by id, then the manifest; existing pixels of other rows stay."""
    table = conform(table)
    check_unique(table)
    parted = table.withColumn("hpx5", hpx_of("source_id")).repartition("hpx5").sortWithinPartitions("hpx5", "source_id")
    parted.write.mode(mode).partitionBy("hpx5").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").parquet(path)
    return finalise_manifest(table.sparkSession, path)


def write_part(table: DataFrame, path: str, pixel: int) -> None:
    """Replaces one pixel; rows of other pixels raise ValueError."""
    table = conform(table)
    other = table.where(hpx_of("source_id") != pixel).limit(1).count()
    if other:
        raise ValueError(f"rows outside pixel {pixel}")
    check_unique(table)
    table.withColumn("hpx5", F.lit(pixel)).coalesce(1).sortWithinPartitions("source_id").write.mode("overwrite").partitionBy("hpx5").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").parquet(path)


def schema() -> T.StructType:
    return T.StructType([*(T.StructField(n, T._parse_datatype_string(k)) for n, k in COLUMNS.items()), T.StructField("hpx5", T.IntegerType())])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema()).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def part_digests(spark: SparkSession, path: str) -> DataFrame:
    """(hpx5, sha256, bytes) of each pixel's files, read by Spark wherever they are; a part is some thousand rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    pixel = F.regexp_extract("path", r"hpx5=(\d+)", 1).cast("int")
    each = files.select(pixel.alias("hpx5"), F.sha2("content", 256).alias("sha256"), "length")
    return each.groupBy("hpx5").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256).alias("sha256"), F.sum("length").alias("bytes"))


def finalise_manifest(spark: SparkSession, path: str) -> dict:
    """Writes manifest.json: rows, bytes and SHA-256 of each part, totals, and the columns that hold anything."""
    counts = read(spark, path).groupBy("hpx5").agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in COLUMNS])
    listed = part_digests(spark, path).join(counts, "hpx5", "left").orderBy("hpx5").collect()  # at most the sphere's 12288 pixels
    filled = {c: sum(r[c] or 0 for r in listed) for c in COLUMNS}
    out = {
        "dataset": "reference catalogue", "hpx_level": sky.HPX_LEVEL, "ref_epoch": sky.REF_EPOCH, "columns": list(COLUMNS), "columns_present": [c for c in COLUMNS if filled[c]],
        "rows": sum(r["rows"] or 0 for r in listed), "bytes": sum(r["bytes"] for r in listed), "parts": {str(r["hpx5"]): {"sha256": r["sha256"], "bytes": r["bytes"], "rows": r["rows"]} for r in listed},
    }
    system, target = _filesystem(spark, f"{path}/manifest.json")
    stream = system.create(target, True)
    try:
        stream.write(bytearray(json.dumps(out, indent=1).encode()))
    finally:
        stream.close()
    return out


def manifest(spark: SparkSession, path: str) -> dict | None:
    system, target = _filesystem(spark, f"{path}/manifest.json")
    if not system.exists(target):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifest.json").collect()))


def present(spark: SparkSession, path: str) -> set[int]:
    system, target = _filesystem(spark, path)
    if not system.exists(target):
        return set()
    return {int(s.getPath().getName().split("=")[1]) for s in system.listStatus(target) if s.getPath().getName().startswith("hpx5=")}


def covers(spark: SparkSession, path: str, ra: float, dec: float, radius_deg: float) -> bool:
    """Whether every published pixel that the cone needs is there, and one at least."""
    needed, have = set(sky.parts_in_cone(ra, dec, radius_deg)), present(spark, path)
    listed = manifest(spark, path)
    if listed is not None:
        needed &= {int(p) for p in listed["parts"]}
    return bool(needed & have) and needed <= have


def cone(spark: SparkSession, path: str, ra: float, dec: float, radius_deg: float, vmag_limit: float | None = None, gmag_limit: float | None = None, epoch: float | None = None) -> DataFrame:
    """The sources within a cone. Only its pixels' folders are read; FileNotFoundError if none is there."""
    pixels = sky.parts_in_cone(ra, dec, radius_deg)
    if not set(pixels) & present(spark, path):
        raise FileNotFoundError(f"no part of {path} touches the cone")
    out = read(spark, path).where(F.col("hpx5").isin(pixels)).where(sky.separation_deg(ra, dec, "ra", "dec") <= radius_deg)
    if vmag_limit is not None:
        out = out.where(F.col("v_jkc_mag") < vmag_limit)
    if gmag_limit is not None:
        out = out.where(F.col("phot_g_mean_mag") < gmag_limit)
    if epoch is not None:
        new_ra, new_dec = sky.propagate_epoch("ra", "dec", "pmra", "pmdec", epoch)
        out = out.withColumns({"ra": new_ra, "dec": new_dec})
    return out.select(*COLUMNS)


def upsert(spark: SparkSession, table: DataFrame, path: str) -> dict:
    """Adds rows to the pixels they touch; an id that is stored already keeps its new row."""
    table = conform(table)
    pixels = [r[0] for r in table.select(hpx_of("source_id")).distinct().collect()]
    if not set(pixels) & present(spark, path):
        return write_dataset(table, path)
    old = read(spark, path).where(F.col("hpx5").isin(pixels)).drop("hpx5").join(table.select("source_id"), "source_id", "left_anti").select(*COLUMNS)
    # The pixels read are the ones written: the rows go aside first.
    aside = f"{path}/_upsert"
    table.unionByName(old).write.mode("overwrite").parquet(aside)
    write_dataset(spark.read.parquet(aside), path)
    system, target = _filesystem(spark, aside)
    system.delete(target, True)
    return finalise_manifest(spark, path)


def remote_cone(sources: DataFrame, photometry: DataFrame, ra: float, dec: float, radius_deg: float, gmag_limit: float) -> DataFrame:
    """The archive's cone query over local tables: sources with synthetic photometry where there is any."""
    near = sources.where(sky.separation_deg(ra, dec, "ra", "dec") <= radius_deg).where(F.col("phot_g_mean_mag") < gmag_limit)
    return near.join(photometry, "source_id", "left")


def region(sources: DataFrame, photometry: DataFrame, ra: float, dec: float, radius_deg: float, v_limit: float = V_LIMIT) -> DataFrame:
    """The archive's region query: sources that have synthetic photometry brighter than a limit."""
    near = sources.where(sky.separation_deg(ra, dec, "ra", "dec") <= radius_deg)
    return conform(near.join(photometry.where(F.col("v_jkc_mag") < v_limit), "source_id"))


def mosaic(fetch, ra: float, dec: float, half_size_deg: float, n_tiles: int = 1) -> DataFrame:
    """Union of ``fetch(ra, dec, radius)`` over tiles, each source once (its smallest row)."""
    radius = half_size_deg / n_tiles * 2**0.5 + 0.1
    parts = [fetch(a, d, radius) for a, d in sky.tile_centres(ra, dec, half_size_deg, n_tiles)]
    return unique(stacked(parts))


def stacked(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables one below the other; columns that one lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def unique(table: DataFrame, key: str = "source_id") -> DataFrame:
    """One row for each key, the smallest by its columns in turn."""
    rest = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(*[F.col(key) if c == key else F.col(f"__row.{c}").alias(c) for c in table.columns])


def read_bulk(spark: SparkSession, paths, columns: dict[str, str]) -> DataFrame:
    """Selected columns of bulk CSV files (gzip too) with a block of # comments before their header."""
    raw = spark.read.option("comment", "#").option("header", "true").option("nullValue", "null").csv(paths)
    return raw.select(*[F.col(c).try_cast(k).alias(c) for c, k in columns.items()])


def build_allsky(positions: DataFrame, photometry: DataFrame, path: str, v_limit: float = V_LIMIT) -> dict:
    """Joins photometry to positions by id, keeps finite V below the limit and writes the dataset."""
    return write_dataset(with_photometry(positions, photometry, v_limit), path)


def with_photometry(positions: DataFrame, photometry: DataFrame, v_limit: float = V_LIMIT) -> DataFrame:
    """Positions with their photometry by id, of finite V below the limit."""
    v = F.col("v_jkc_mag")
    return positions.join(photometry, "source_id").where(v.isNotNull() & ~F.isnan(v.cast("double")) & (v < v_limit))


def stage_bulk(spark: SparkSession, path: str, out: str, columns: dict[str, str]) -> bool:
    """Extracts one bulk file's columns to a Parquet table of its own below ``out``; False if its marker says that this is done.

    Spark's _SUCCESS file is the marker: a table whose writing was broken off is made anew.
    """
    target = f"{out}/{path.rstrip('/').rpartition('/')[2]}"
    system, marker = _filesystem(spark, f"{target}/_SUCCESS")
    if system.exists(marker):
        return False
    read_bulk(spark, path, columns).write.mode("overwrite").parquet(target)
    return True


def staged(spark: SparkSession, out: str, columns: dict[str, str]) -> DataFrame:
    """All tables that ``stage_bulk`` has made."""
    return spark.read.schema(", ".join(f"{c} {k}" for c, k in columns.items())).parquet(f"{out}/*")


def verify_parts(spark: SparkSession, path: str) -> list[int]:
    """The pixels whose files differ from the manifest, or of which it has no part or the dataset none."""
    listed = {int(p): x["sha256"] for p, x in (manifest(spark, path) or {"parts": {}})["parts"].items()}
    here = {r["hpx5"]: r["sha256"] for r in part_digests(spark, path).collect()}  # at most the sphere's 12288 pixels
    return sorted(p for p in listed.keys() | here.keys() if listed.get(p) != here.get(p))


def missing_parts(spark: SparkSession, path: str, published: dict) -> DataFrame:
    """(hpx5, sha256) of published parts that are not here."""
    rows = [(int(p), x["sha256"]) for p, x in published["parts"].items()]
    have = spark.createDataFrame([(p,) for p in sorted(present(spark, path))], "hpx5 int")
    return spark.createDataFrame(rows, "hpx5 int, sha256 string").join(have, "hpx5", "left_anti")
