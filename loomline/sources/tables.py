"""Readers of the tables, and the catalog views the queries work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a status (1 pending, 2 needs review, 3 indexed, 4 failed) and a tenant scope."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, 4).when(F.col("quality") == 1, 3).when(F.col("quality") == 0, 2).otherwise(1)
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", status.alias("status_id"), (F.col("doc_id") % 5).alias("entity_id"), (F.col("doc_id") % 3 == 0).alias("is_global"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_index, line): one row for each line of a text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "line"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events with tokens and a cost in exact decimals."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    cost = (F.col("value").cast("decimal(12,4)") * F.coalesce(k, F.lit(0)).cast("decimal(6,0)") / 1000).cast("decimal(14,8)")
    return events.select("event_id", "ts", "user_id", "event_type", "value", F.coalesce(k, F.lit(0)).alias("k"), cost.alias("cost"))
