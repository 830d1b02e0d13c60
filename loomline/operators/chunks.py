"""Chunks of documents: blocks of lines of one kind, and blocks put together up to a size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import columns as C


def blocks(rows: DataFrame) -> DataFrame:
    """Runs of lines of one kind (doc_id, block, kind, n_lines, chars, tokens); blank lines end a block and are left out."""
    order = Window.partitionBy("doc_id").orderBy("line_index")
    kinds = rows.withColumn("kind", C.line_kind("line"))
    cut = F.when((F.col("kind") == "blank") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order)), 1).otherwise(0)
    runs = kinds.withColumn("cut", cut).withColumn("block", F.sum("cut").over(order)).where("kind <> 'blank'")
    return runs.groupBy("doc_id", "block").agg(F.min("kind").alias("kind"), F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("chars"), F.sum(C.n_tokens("line")).alias("tokens"))


def merge_blocks(found: DataFrame, size: int) -> DataFrame:
    """Neighbouring blocks put together while they hold up to `size` tokens (doc_id, chunk, first_block, tokens). A larger
    block is a chunk of its own. Only numbers of a document's blocks are gathered, not its text."""
    each = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "tokens"))).alias("blocks"))
    start = F.struct(F.array().cast("array<struct<first_block:bigint,tokens:bigint>>").alias("done"), F.lit(None).cast("bigint").alias("first_block"), F.lit(0).cast("bigint").alias("tokens"))

    def step(s, b):
        fits = s.first_block.isNull() | (s.tokens + b.tokens <= size)
        done = F.when(fits, s.done).otherwise(F.concat(s.done, F.array(F.struct(s.first_block.alias("first_block"), s.tokens.alias("tokens")))))
        return F.struct(done.alias("done"), F.when(fits, F.coalesce(s.first_block, b.block)).otherwise(b.block).alias("first_block"), F.when(fits, s.tokens + b.tokens).otherwise(b.tokens).alias("tokens"))

    end = lambda s: F.concat(s.done, F.array(F.struct(s.first_block.alias("first_block"), s.tokens.alias("tokens"))))
    return each.select("doc_id", F.posexplode(F.aggregate("blocks", start, step, end)).alias("chunk", "made")).select("doc_id", "chunk", "made.first_block", "made.tokens")
