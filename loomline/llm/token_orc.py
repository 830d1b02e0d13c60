"""Token ids of a corpus in ORC files.

Layout: documents in ascending doc_id order (equal ids by text), one row each: doc_id, ids array<int> (ORC writes integers
with run-length encoding), part (number of the file's writer, ascending with doc_id) and part_start (ids of the part before
the row). Row indexes and a Bloom filter on doc_id let a reader skip stripes and row groups by file metadata, and stripes
are read in parallel. Global starts are part_start plus the ids of all parts before; only one number a part is summed for
that.

Defined results: a null text has no ids but the end id; an empty table writes no rows and reads as none; repeated rows are
documents of their own, one after another; extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.bpe import encoder
from loomline.llm.shared import lean

SCHEMA = "doc_id long, ids array<int>, part int, part_start long"
#: Texts encoded together; where words hardly repeat, what is made of them has about fifty times as much.
BLOCK_BYTES = 8 << 20


def ids_array(raw: list[bytes]) -> pa.Array:
    """Little-endian 32-bit ids of each document as an Arrow list."""
    offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in raw]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def blocks(batches, most: int):
    """Consecutive batches as tables of about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 64 << 20, index_rows: int = 1_000) -> None:
    """Encode whole texts and write them in doc_id order. Texts are dealt by range of (doc_id, hash of the text), so that
    not even one repeated id meets in one task."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode, part, before = encoder(tokenizer).encode_all, TaskContext.get().partitionId(), 0
        for block in blocks(batches, BLOCK_BYTES):
            for batch in block.to_batches():
                raw = [b + end for b in encode(batch.column("text"))]
                for at in range(0, len(raw), 256):  # so that a few documents are sent at a time
                    some = raw[at : at + 256]
                    n = np.array([len(b) // 4 for b in some], np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 256), ids_array(some), pa.array(np.full(len(some), part, np.int32)), pa.array(before + np.cumsum(n) - n)], ["doc_id", "ids", "part", "part_start"])
                    before += int(n.sum())

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*keys).sortWithinPartitions(*keys)
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(index_rows), "orc.stripe.size": str(stripe_bytes)}
    dealt.mapInArrow(lean(run), SCHEMA).write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files; a filter on doc_id is pushed down to stripe statistics, row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def starts(rows: DataFrame) -> DataFrame:
    """rows with `start`: the ids of all documents before. One row a part is summed in order and joined back."""
    sizes = rows.groupBy("part").agg(F.sum(F.size("ids").cast("long")).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows with starts."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            n = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(n)
            crc = [zlib.crc32(flat[b - k : b].tobytes()) for b, k in zip(ends, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
