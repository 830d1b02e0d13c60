"""Preparation of a training corpus: five stages, each written as Parquet and read again as the next one's documents.

Each stage fits what it learns on its own input. Stages but the last return the columns of documents, whatever their
names and order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import language_nb, lsh_forest, packing, quality_mil, secret_scan
from loomline.llm.queries import BPE_FILE, QUALITY_CUT, tokenizer_path
from loomline.llm.shared import Scratch, ship_package, table

#: A document whose language is less certain goes.
LANGUAGE_CUT = 0.5

#: A learned step, and exact ids of a tokenizer: not for SQL. Tested against brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that run keeps, with the columns of docs as they were: extra ones go through it under names of their own, which no
    operator's columns can meet."""
    inner = [c if c in ("doc_id", "text", "n_chars") else f"input__{i}" for i, c in enumerate(docs.columns)]
    return run(docs.toDF(*inner)).select(*(F.col(a).alias(b) for a, b in zip(inner, docs.columns, strict=True)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts."""
    ship_package(spark)
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"))
    return _apart(docs, lambda d: quality_mil.score(spark, d, model, "_score").where(F.col("_score") >= QUALITY_CUT))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language."""
    ship_package(spark)
    model = language_nb.fit(docs)
    return _apart(docs, lambda d: language_nb.predict(spark, d, model, "_lang", "_score").where((F.col("_lang") != "und") & (F.col("_score") >= LANGUAGE_CUT)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies; rows without an id, or with the same, count each."""
    ship_package(spark)
    return _apart(docs, lambda d: lsh_forest.distinct_documents(spark, d, width=5, percent=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with their secrets replaced by a mark."""
    ship_package(spark)
    model = secret_scan.fit(docs)
    return _apart(docs, lambda d: secret_scan.redact(secret_scan.scan(spark, d, model)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, with their token ids."""
    ship_package(spark)
    return packing.pieces(docs, tokenizer_path(BPE_FILE), end_id=0)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = scratch.keep(stage(spark, docs, sf_dir), name)
        if hasattr(docs, "scratch_path"):
            scratch.drop(docs)
        docs = made
    return docs
