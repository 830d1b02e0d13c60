"""Importance resampling: documents whose hashed words are likelier in a target text set than in the corpus are drawn first.

1. The bucket of a feature is its CRC-32 modulo the number of buckets, from position tables (position_crc). One pass over the
   corpus and one over the target count features by bucket; a row for each bucket and task is shuffled.
2. A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus, in floored thousandths. A second
   pass gives each document the floored mean gain of its features, and adds a Gumbel value made from its id: the highest sums
   are a draw without replacement in proportion to exp(weight / 1000).
3. Counts by score (a bounded number of integers: gains and Gumbel values have logarithmic bounds) give the least score that
   can be drawn; only rows at or over it are ordered, by range, for their ranks.

Defined results: a null or empty text has no features, weight 0, and is never drawn (least_words); a null doc_id hashes as the
empty string and comes before all ids in ties; repeated rows count each, and share a score; an empty corpus gives no rows, an
empty target gives gains for t = T = 0; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.position_crc import crc32_spans
from loomline.llm.ranges import numbered
from loomline.llm.shared import Scratch, lean
from loomline.llm.sql import CRC_TABLE, crc32
from loomline.llm.texts import runs, slices, spread, utf8

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 2024

#: By byte: its lower-case form (A-Z only), and whether it belongs to a word: digits, letters, all of a code point over 0x7F.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its number of words; its number of features (runs of 1 to longest words, joined by one space); the
    buckets of all features, text by text."""
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends, firsts = runs(WORD[data], offsets)
    n_words = np.diff(firsts)
    if longest > 1:  # words one space apart, so that a run of them is a span
        lengths = ends - starts
        at = np.cumsum(lengths + 1) - lengths - 1
        joined = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
        joined[np.repeat(at, lengths) + spread(lengths)] = data[np.repeat(starts, lengths) + spread(lengths)]
        data, starts, ends = joined, at, at + lengths
    first, last, owner = [], [], []
    for n in range(1, longest + 1):
        made = np.maximum(n_words - n + 1, 0)
        heads = np.repeat(firsts[:-1], made) + spread(made)
        first.append(starts[heads])
        last.append(ends[heads + n - 1])
        owner.append(np.repeat(np.arange(len(made)), made))
    owner = np.concatenate(owner)
    by_text = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
    found = crc32_spans(data, np.concatenate(first)[by_text], np.concatenate(last)[by_text]) % np.uint32(buckets)
    return n_words, np.bincount(owner, minlength=len(n_words)), found.astype(np.int64)


def counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts each bucket holds."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(features(part.column("text"), longest, buckets)[2], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["bucket", "n"])

    out = [0] * buckets
    for bucket, n in docs.select("text").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[bucket] = n
    return out


def gains(target: list[int], corpus: list[int]) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's smoothed shares."""
    m, t_all, s_all = len(corpus), float(sum(target) + len(corpus)), float(sum(corpus) + len(corpus))
    return np.array([math.floor(1000 * math.log((target[i] + 1) * s_all / ((corpus[i] + 1) * t_all))) for i in range(m)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """Floored thousandths of the Gumbel value that a document's id stands for."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n_words, n, found = features(part.column("text"), longest, len(gain))
                sums = np.concatenate(([0], np.cumsum(gain[found])))
                ends = np.cumsum(n)
                weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
                score = weight + np.array([gumbel(i, seed) for i in part.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight, score))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), ", ".join(f"{c} long" for c in names))


def draw(scratch: Scratch, scored: DataFrame, percent: int, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with `rank`: 1, 2, 3... for the highest `percent` of all scores of documents with enough words, else null."""
    scored = scratch.keep(scored, "scored")
    fit = F.col("n_words") >= least_words
    by_score = sorted(scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    most = percent * sum(n for _, n in by_score) // 100
    cut, above = None, 0
    for score, n in by_score:
        if above >= most:
            break
        cut, above = score, above + n
    blank = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select("*", blank)
    can = fit & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("_row").asc()]
    ranked = numbered(scratch, scored.where(can).withColumn("_row", F.monotonically_increasing_id()), order, "ranges")
    rank = F.when(F.col("number") < most, F.col("number") + 1).alias("rank")
    return scored.where(~can).select("*", blank).unionByName(ranked.select(*scored.columns, rank))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Every document's words, features, weight, score, and its rank if it is drawn."""
    gain = gains(counts(target, longest, buckets), counts(docs, longest, buckets))
    return draw(Scratch(spark, "resample"), weighed(docs, gain, longest), percent)


SQL = rf"""
WITH {CRC_TABLE},
texts AS (SELECT 'S' AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'T', NULL, row_number() OVER (), text FROM benchmark),
words AS (SELECT side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
hashed AS (SELECT word, {crc32("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM words), crc_table),
found AS (SELECT side, r, bucket FROM words JOIN hashed USING (word)),
held AS (SELECT bucket, count(*) FILTER (side = 'S') AS s, count(*) FILTER (side = 'T') AS t FROM found GROUP BY bucket),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM held),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM held, sums),
weights AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM found JOIN gains USING (bucket) WHERE side = 'S' GROUP BY r),
scored AS (
  SELECT doc_id, r, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) WHERE side = 'S'),
ranked AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(place) FROM ranked) // 100 THEN place END AS rank FROM ranked
"""
