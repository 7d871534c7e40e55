"""Tables in Enhanced Character-Separated Values: a YAML header of # lines, then a header line and rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column types by the header's names: fixed values.
TYPES = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "float16": "float", "float32": "float", "float64": "double", "string": "string"}


def columns_of(head: list[str]) -> tuple[dict[str, str], str]:
    """(types by column, delimiter) of a file's # lines."""
    text = "\n".join(line.removeprefix("#").removeprefix(" ") for line in head)
    found = re.findall(r"-\s*\{[^{}]*?name:\s*('[^']*'|\"[^\"]*\"|[^,{}]+)[^{}]*?datatype:\s*(\w+)[^{}]*\}", text)
    if not found:  # one key to a line
        found = re.findall(r"-\s*name:\s*(\S+)\s*(?:\n\s+\w+:[^\n]*)*?\n\s+datatype:\s*(\w+)", text)
    mark = re.search(r"^delimiter:\s*'?\"?(.)", text, re.M)
    return {n.strip().strip("'\""): TYPES.get(k, "string") for n, k in found}, mark[1] if mark else " "


def read_ecsv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file, typed by its header; empty fields are NULL. A file without such a header raises ValueError."""
    head = [r["value"] for r in spark.read.text(path).where(F.col("value").startswith("#")).limit(10_000).collect()]
    kinds, mark = columns_of(head)
    if not kinds or not any("ECSV" in line for line in head[:2]):
        raise ValueError(f"{path}: no ECSV header")
    raw = spark.read.option("comment", "#").option("header", "true").option("sep", mark).option("quote", '"').option("escape", '"').option("emptyValue", None).csv(path)
    return raw.select(*[F.col(f"`{c}`").try_cast(k).alias(c) if c in raw.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


def write_ecsv(df: DataFrame, path: str) -> None:
    """Writes a small table as one file for other tools; it goes through the driver, for tables of at most some hundred thousand rows."""
    import csv
    import io

    from .fits import write_bytes

    back = {v: k for k, v in TYPES.items() if k not in ("uint8", "uint16", "uint32", "float16")}
    rows = df.limit(500_001).collect()
    if len(rows) > 500_000:
        raise ValueError("over 500,000 rows; write Parquet")
    out = io.StringIO()
    out.write("# %ECSV 1.0\n# ---\n# datatype:\n")
    for name, kind in df.dtypes:
        out.write(f"# - {{name: {name}, datatype: {back.get(kind, 'string')}}}\n")
    writer = csv.writer(out, delimiter=" ", lineterminator="\n")
    writer.writerow(df.columns)
    for row in rows:
        writer.writerow(["" if v is None else v for v in row])
    write_bytes(path, out.getvalue().encode())
