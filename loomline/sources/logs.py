"""The last lines of the newest log files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
STAMP, RUN = r"^\[([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})\]", r"_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}$"
MAX_LINES, MAX_BYTES, MAX_FILES = 200, 262_144, 4
EMPTY = "path string, file int, nth long, stamp string, line string"


def name_pattern(path: str) -> str:
    """Files of the same log: its name up to the first stop, without the time of a run."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return re.sub(RUN, "", name.split(".")[0] or name) + "*.log*"


def newest(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    """(path, size, modified) of the newest files of a log, from metadata alone; equally new ones by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name_pattern(path)).load(path.rsplit("/", 1)[0])
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path").limit(max(1, max_files))


def tail(spark: SparkSession, path: str, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """(path, file, nth, stamp, line), at most max_lines of them, in order: the last lines of the newest files of a log (file 0 the newest)
    by their stamp, those without one first; equal stamps by file and by nth, the line's number from the end of its file.

    Of a file, lines count that lie in its last max_bytes, but for the first of a file that is longer. The files are named by the driver
    (max_files at most), each is read in splits, and of each split the last lines alone go on. A log without files has no lines."""
    most, tails = max(1, max_lines), []
    for i, file in enumerate(newest(spark, path, max_files).collect()):
        at = [F.desc("start"), F.desc("id")]
        last = spark.read.text(file["path"]).select(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line")).orderBy(*at).limit(most)
        counted = Window.partitionBy(F.lit(i)).orderBy(*at)  # of max_lines rows
        bytes_from_end = F.sum(F.octet_length("line") + 1).over(counted.rowsBetween(Window.unboundedPreceding, 0))
        within = F.lit(True) if file["size"] <= max(1024, max_bytes) else F.col("size") < max(1024, max_bytes)
        rows = last.select("line", bytes_from_end.alias("size"), F.row_number().over(counted).cast("long").alias("nth")).where(within)
        tails.append(rows.select(F.lit(file["path"]).alias("path"), F.lit(i).alias("file"), "nth", F.regexp_extract("line", STAMP, 1).alias("stamp"), "line"))
    if not tails:
        return spark.createDataFrame([], EMPTY)
    merged = reduce(DataFrame.unionByName, tails)
    return merged.orderBy(F.desc("stamp"), F.desc("file"), "nth").limit(most).orderBy("stamp", "file", F.desc("nth"))
