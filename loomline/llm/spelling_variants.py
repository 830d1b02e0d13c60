"""Groups of spelling variants: words one edit apart, found in dense tiles of code-point matrices.

1. One pass counts words of LEAST_LENGTH code points and more, document by document (a missing letter is planted by a hash of
   document and word); counts are summed over all documents.
2. Two words whose longer one has L code points are one edit apart just if their common prefix p and suffix s have
   p + s >= L - 1. Positions 0..L-1 are cut into segments of WIDTH; in the segment that holds p, both words have all letters
   before the segment, and all after it, in common. A word therefore goes into a bucket for each segment, of its own length
   and of one more; each pair of near words meets, and is taken, in the bucket of its p alone. At WIDTH 2 a bucket's words
   differ in two letters at most, so that its size is bounded by the square of the alphabet (the 90 letters of op13: 8,190
   words), whatever the corpus. Words over 2 * SEGMENTS letters have SEGMENTS wider segments, as their keys would add up.
3. Rows are dealt and sorted by bucket. Blocks of TILE rows are compared with themselves and the following blocks while those
   share a bucket: both words of a pair as rows of padded matrices, forwards and backwards, give p and s.
4. Each word keeps the count of its near words and the best of them; forms are followed by pointer doubling (each step is to
   a word at least RATIO times as frequent, so chains are short).

Defined results: a null or empty text has no words; a null doc_id hashes as the empty string; repeated rows count each; an
empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import Scratch, lean
from loomline.llm.sql import CRC_TABLE, crc32
from loomline.llm.texts import code_points, spread

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP_EVERY = 7, 2, 10, 31
WIDTH, SEGMENTS, TILE = 2, 16, 128
#: Words that a task remembers before it hands their counts on.
HELD_WORDS = 100_000


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of all documents; a word that drop_every divides the hash of lacks one letter in its document."""
    pattern = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_length)  # a shorter run has too few letters, whole or not

    def handed(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(pattern.findall(text.as_py() or "")).items():
                    word = word.encode("latin-1").lower().decode("latin-1")  # bytes know A-Z alone
                    h = zlib.crc32(word.encode(), start)
                    if h % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield handed(held)
                    held.clear()
        yield handed(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def buckets(counted: DataFrame) -> DataFrame:
    """A row for each word, length (its own, and one more) and segment: what lies outside the segment, hashed."""
    length = F.char_length("word")
    each = counted.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer"))
    width = F.greatest(F.lit(WIDTH), F.ceil(F.col("longer") / SEGMENTS)).cast("int")
    each = each.select("*", width.alias("width")).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("longer") - 1) / F.col("width")).cast("int"))).alias("segment"))
    begin = F.col("segment") * F.col("width")
    end = F.least(begin + F.col("width"), F.col("longer"))
    key = F.xxhash64("longer", "segment", F.substring("word", F.lit(1), begin), F.substring("word", F.char_length("word") - (F.col("longer") - end) + 1, F.col("longer") - end))
    return each.select("longer", key.alias("bucket"), "segment", "width", "word", "n")


def _matrices(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, padded: from the left, from the right, and their lengths."""
    points, at = code_points(rows.column("word").combine_chunks())
    lengths = np.diff(at)
    small = points.astype(np.uint8) if points.max(initial=0) < 256 else points
    forward = np.zeros((len(lengths), int(lengths.max(initial=0))), small.dtype)
    backward = forward.copy()
    owner, place = np.repeat(np.arange(len(lengths)), lengths), spread(lengths)
    forward[owner, place] = small
    backward[owner, np.repeat(lengths, lengths) - 1 - place] = small
    return forward, backward, lengths


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many columns from the left agree, row by row."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), most), most)


def tiles(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose words are near, in rows that are sorted by (longer, bucket) and cut between buckets."""
    column = lambda c: rows.column(c).to_numpy()
    bucket, longer, segment, width = (column(c) for c in ("bucket", "longer", "segment", "width"))
    forward, backward, lengths = _matrices(rows)
    left, right = [], []
    for a in range(0, rows.num_rows, TILE):
        x = slice(a, a + TILE)
        for b in range(a, rows.num_rows, TILE):
            y = slice(b, b + TILE)
            if b > a and (bucket[b], longer[b]) != (bucket[x][-1], longer[x][-1]):
                break
            same = (bucket[x, None] == bucket[None, y]) & (longer[x, None] == longer[None, y]) & (segment[x, None] == segment[None, y])
            same &= np.maximum(lengths[x, None], lengths[None, y]) == longer[x, None]  # two shorter words meet under their own length
            i, j = np.nonzero(np.triu(same, 1) if a == b else same)
            i, j = i + a, j + b
            most = np.minimum(lengths[i], lengths[j])
            p = _common(forward[i], forward[j], most)
            s = _common(backward[i], backward[j], most)
            near = (p + s >= longer[i] - 1) & (p // width[i] == segment[i])
            left.append(i[near])
            right.append(j[near])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def neighbours(counted: DataFrame) -> DataFrame:
    """(word, other, other_n): each pair of near words, both ways, once."""

    def found(rows: pa.Table):
        i, j = tiles(rows)
        both, others = pa.array(np.concatenate((i, j))), pa.array(np.concatenate((j, i)))
        out = pa.table({"word": rows.column("word").take(both), "other": rows.column("word").take(others), "other_n": rows.column("n").take(others)})
        yield from out.to_batches()

    def run(batches):
        held = None  # rows of the last bucket, which may go on
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = np.flatnonzero((rows.column("bucket").to_numpy() != rows.column("bucket")[-1].as_py()) | (rows.column("longer").to_numpy() != rows.column("longer")[-1].as_py()))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from found(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield from found(held)

    return buckets(counted).repartition("bucket").sortWithinPartitions("longer", "bucket").mapInArrow(lean(run), "word string, other string, other_n long")


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: each round joins what a word leads to with what that leads to."""
    now = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.alias("a").join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = scratch.keep(after.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        now = after.select("word", "root")
        now.scratch_path = after.scratch_path
        if after.where("moved").isEmpty():
            return now


def variants(spark: SparkSession, docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs often enough."""
    scratch = Scratch(spark, "variants")
    counted = scratch.keep(words(docs).where(F.col("n") >= least_count), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))
    near = scratch.keep(neighbours(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near")
    all_words = counted.join(near, "word", "left")
    often = -F.col("best.less") >= ratio * F.col("n")
    all_words = scratch.keep(all_words.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "formed")
    root = roots(scratch, all_words.where(F.col("form").isNotNull()))
    return all_words.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
in_doc AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM in_doc, crc_table),
written AS (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
lacking AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM lacking a JOIN lacking b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT l.word, w.word, w.n FROM lacking l JOIN words w ON w.word = l.rest
  UNION
  SELECT w.word, l.word, l.n FROM lacking l JOIN words w ON w.word = l.rest),
best AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'other': other}}) AS best FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {RATIO} * n THEN best.other END AS form, CASE WHEN -best.less >= {RATIO} * n THEN -best.less END AS form_n FROM words LEFT JOIN best USING (word)),
leads AS (SELECT word, word AS to FROM formed UNION ALL SELECT l.word, f.form FROM leads l JOIN formed f ON f.word = l.to WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.to AS root, f.n, f.n_near, f.form_n FROM formed f JOIN leads l USING (word) JOIN formed e ON e.word = l.to WHERE e.form IS NULL
"""
