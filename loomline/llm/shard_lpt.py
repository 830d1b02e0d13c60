"""Sharding by longest-processing-time scheduling: groups of equal texts, largest first, go to the least-loaded shard.

1. One pass over the texts keeps of each row its id, size, checksum and a hash of the text; equal texts have equal hashes
   (were two texts ever to share one, they would only stay together as well). Sizes are summed by hash, map-side first.
2. A group with at least 1 / (UNITS * shards) of all bytes is a unit of its own: there are at most UNITS * shards of them,
   however large the corpus is. Smaller groups share BUNDLES * shards units by checksum. The driver gets these units alone,
   sorts them by size and deals them through a heap of loads; a shard ends at most one unit above the mean, apart from a group
   that is larger than a shard by itself and can't be cut.
3. Rows look their group's shard up in the two bounded tables (broadcast), and get gapless slots in order of doc_id by range,
   so that no task holds a whole shard.

Defined results: a null text has no bytes and belongs to the group of empty texts; a null doc_id comes first in its shard;
repeated rows have a slot each; an empty table gives no rows. Columns named in `carry` go along; others are left out.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.ranges import numbered
from loomline.llm.shared import Scratch
from loomline.llm.sql import CRC_TABLE, crc32

#: What a row takes besides its text.
ROW_BYTES = 16
#: Bounds on what the heap gets, for each shard.
UNITS, BUNDLES = 1000, 256


def schedule(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit: longest first, to the least load (ties: the first unit, the lowest shard)."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + sizes[i], shard))
        out[i] = shard
    return out


def assign(spark: SparkSession, docs: DataFrame, shards: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, with the columns of `carry`."""
    scratch = Scratch(spark, "shards")
    text = F.coalesce("text", F.lit(""))
    sized = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_group"), *(F.col(c).alias(f"_carry_{c}") for c in carry)), "sized")
    total = sized.agg(F.sum("size")).first()[0] or 0
    groups = sized.groupBy("_group").agg(F.sum("size").alias("size"), F.min("doc_id").alias("first"), F.min("text_crc32").alias("crc"))
    large = F.col("size") * UNITS * shards >= total
    units = groups.groupBy(large.alias("large"), F.when(large, F.col("_group")).otherwise(F.col("crc") % (BUNDLES * shards)).alias("unit")).agg(F.sum("size").alias("size"), F.min("first").alias("first")).collect()  # at most (UNITS + BUNDLES) * shards rows
    units.sort(key=lambda u: (u["first"] is not None, u["first"], u["unit"]))
    dealt = schedule([u["size"] for u in units], shards)
    whole = spark.createDataFrame([(u["unit"], s) for u, s in zip(units, dealt, strict=True) if u["large"]], "_group long, _whole int")
    parts = spark.createDataFrame([(u["unit"], s) for u, s in zip(units, dealt, strict=True) if not u["large"]], "_bundle long, _part int")
    placed = sized.withColumn("_bundle", F.col("text_crc32") % (BUNDLES * shards)).join(F.broadcast(whole), "_group", "left").join(F.broadcast(parts), "_bundle", "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("_whole", "_part").alias("shard"), F.monotonically_increasing_id().alias("_row"), *(f"_carry_{c}" for c in carry))
    out = numbered(scratch, placed, [F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("_row")], "ranges", "slot")
    first = out.groupBy("shard").agg(F.min("slot").alias("_first"))
    out = out.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - F.col("_first")).alias("slot"), *(F.col(f"_carry_{c}").alias(c) for c in carry))


def write(spark: SparkSession, docs: DataFrame, shards: int, path: str) -> None:
    """The documents as Parquet, a folder for each shard, dealt by ranges of slots, so that a large shard has many files."""
    order = [F.col("shard"), F.col("slot")]
    assign(spark, docs, shards, ("text",)).select("doc_id", "text", "slot", "shard").repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("shard").parquet(path)


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
sized AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + {ROW_BYTES} AS size, {crc32("coalesce(text, '')")} AS crc FROM documents, crc_table),
grouped AS (SELECT text, crc, sum(size)::BIGINT AS size, min(doc_id) AS first FROM sized GROUP BY text, crc),
named AS (SELECT *, CASE WHEN size * {UNITS} * 40 >= (SELECT sum(size) FROM sized) THEN 'text ' || text ELSE 'bundle ' || crc % ({BUNDLES} * 40) END AS unit FROM grouped),
units AS (SELECT unit, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY sum(size) DESC, min(first) NULLS FIRST) AS i FROM named GROUP BY unit),
dealt AS (
  SELECT 0::BIGINT AS i, list_transform(range(40), lambda s: 0::BIGINT) AS loads, 0::BIGINT AS least
  UNION ALL
  SELECT u.i, list_transform(loads, lambda load, s: CASE WHEN s = list_position(loads, list_min(loads)) THEN load + u.size ELSE load END), list_position(loads, list_min(loads))
  FROM dealt d JOIN units u ON u.i = d.i + 1)
SELECT doc_id, s.size, s.crc AS text_crc32, 'bytes' AS law, (least - 1)::INT AS shard, row_number() OVER (PARTITION BY least ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM sized s JOIN named USING (text) JOIN units USING (unit) JOIN dealt USING (i)
"""
