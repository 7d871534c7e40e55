"""New frames as they arrive: a file stream, one availableNow run per call, rows appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.project import Project
from ..plans.stages import add_frames, pending, table

FILES = "path string, modificationTime timestamp, length long, content binary"


def frame_stream(spark: SparkSession, project: Project, max_files: int = 25) -> DataFrame:
    """Paths of frames below the project's (single) root; contents are never read here."""
    glob = "{" + ",".join(project.patterns) + "}"
    root = project.frame_roots if isinstance(project.frame_roots, str) else project.frame_roots[0]
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
    return stream.load(root).select("path", "length")


def run(spark: SparkSession, project: Project, max_files: int = 25) -> int:
    """Characterises the frames that came since the last run; the number of rows that were added.

    A batch that a lost driver repeats adds nothing twice: rows that are there already are
    left out, and the file log keeps what is done.
    """
    before = table(spark, project.frames_path)
    n = before.count() if before is not None else 0

    def batch(df: DataFrame, _: int) -> None:
        keys = pending(df.select("path"), table(spark, project.frames_path))
        if keys.limit(1).count():
            add_frames(spark, project, keys)

    query = frame_stream(spark, project, max_files).writeStream.foreachBatch(batch).option("checkpointLocation", project.path("_stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    after = table(spark, project.frames_path)
    return (after.count() if after is not None else 0) - n


def windowed_zeropoints(measurements: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Running mean zero points by band over event-time windows of a stream (ts, band, zp); rows later than ``late`` are dropped."""
    return measurements.withWatermark("ts", late).groupBy(F.window("ts", window), "band").agg(F.count("*").alias("n"), F.avg("zp").alias("zp")).select("window.start", "window.end", "band", "n", "zp")
