"""Files of a folder tree as a table: a scan with filters, and a manifest to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, extensions: list[str], skipped_folders: list[str] = (), with_digest: bool = False) -> DataFrame:
    """(path, size, modified) of files with an extension, without empty and temporary (`~$`) ones and those below a skipped folder
    (names in either case, anywhere under `folder`); with_digest adds sha256. Contents are read for a digest only."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where("length > 0")
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin([e.lower().lstrip(".") for e in extensions]) & F.contains(name, F.lit(".")) & ~F.startswith(name, F.lit("~$")))
    if skipped_folders:
        inside = F.split(F.lower(F.element_at(F.split("path", folder.split(":", 1)[-1].rstrip("/"), 2), -1)), "/")
        rows = rows.where(~F.arrays_overlap(F.slice(inside, 1, F.size(inside) - 1), F.array(*(F.lit(f.lower()) for f in skipped_folders))))
    digest = [F.sha2("content", 256).alias("sha256")] if with_digest else []
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *digest)


def natural_order() -> list:
    """The order of a manifest: by the digits of a file's name, then by path in lower case."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    digits = F.regexp_replace(stem, r"\D", "")
    return [F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(0)), F.lower("path")]
