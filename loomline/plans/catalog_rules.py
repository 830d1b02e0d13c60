"""Queries on replacing the rows of sources, with what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import relational as R
from loomline.plans.registry import query
from loomline.sources.tables import table
from loomline.streaming.work import shared_folder

#: The batch that comes in: all sources of one ending, read anew without their documents of under so many characters.
ENDING, SHORTEST = "1", 200

_BATCH = f"""incoming AS (SELECT doc_id, trim(text) AS text, source FROM documents WHERE ends_with(source, '{ENDING}') AND length(text) >= {SHORTEST}), named AS (SELECT DISTINCT source FROM incoming),
rows AS (SELECT doc_id, text, source FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM named) UNION ALL SELECT * FROM incoming)"""


def batch(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return docs, docs.where(F.endswith("source", F.lit(ENDING)) & (F.length("text") >= SHORTEST)).withColumn("text", F.trim("text"))


@query(f"WITH {_BATCH} SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS chars, min(doc_id) AS first_id, max(doc_id) AS last_id FROM rows GROUP BY source")
def replaced_sources(spark, sf_dir):
    """The catalog, written as a table by source and read back after a batch replaced the sources it has."""
    docs, incoming = batch(spark, sf_dir)
    path = shared_folder(spark, "catalog")
    R.write_sources(docs, path, "source")
    R.write_sources(incoming, path, "source")
    kept = spark.read.schema("doc_id long, text string, source string").parquet(path)
    return kept.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(f"""WITH {_BATCH}, gone AS (SELECT source, doc_id FROM documents WHERE source IN (SELECT source FROM named) AND doc_id NOT IN (SELECT doc_id FROM incoming))
SELECT source, count(*) AS removed, count(l.doc_id) AS removed_labels, min(g.doc_id) AS first_id, max(g.doc_id) AS last_id FROM gone g LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def removed_documents(spark, sf_dir):
    """What a batch removes: documents that are no longer in their source, and the labels that go with them."""
    docs, incoming = batch(spark, sf_dir)
    rows, removed = R.replace_sources(docs, incoming, "source")
    gone = removed.join(incoming, "doc_id", "left_anti").select("doc_id", "source")
    _, labels = R.cascade(table(spark, sf_dir, "labels").select("doc_id"), rows, "doc_id")
    counted = gone.join(labels.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    return counted.groupBy("source").agg(F.count("*").alias("removed"), F.coalesce(F.sum("n"), F.lit(0)).alias("removed_labels"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
