"""What the operators share: scratch tables in the cluster's shared folder, and shipping this package to workers."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only where that is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        given = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


class Scratch:
    """Tables written to the shared folder: a cut in the lineage that outlives a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def path(self, name: str) -> str:
        self.tables += 1
        return f"{self.root}/{self.tables:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, and return what reads it again."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in kept:
            where = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it (once a session), and keep the batches of texts
    that they get small."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if getattr(sc, "_loomline_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "loomline_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(target)
    sc._loomline_shipped = True


def lean(run):
    """A function of Arrow batches whose worker gives its memory back when a task ends: workers live on from one stage to
    the next, and what their allocators keep would add up."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return task


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows from which no classifier learns: crc32 of the id's text is a multiple of 5 (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def bounded_sample(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About `most` rows at any size of df (all, if it has fewer), picked by a hash of the key: the same rows in every run."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
