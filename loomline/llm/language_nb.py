"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are summed by Spark over a bounded sample of labelled documents; the matrix of log
probabilities (languages x BUCKETS, so of a fixed size) is broadcast, and batches are scored in numpy.

Defined results: a null text, or one without a letter, is `und` with score 0; null languages are not learned; without any
labelled text every prediction is `und`; equal scores go to the language that sorts first. Repeated rows are rows of
their own; other columns pass through untouched, and a column that clashes with a result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import texts as tx
from loomline.llm.shared import bounded_sample, held_out, lean

BUCKETS = 1 << 16
#: n-grams of these lengths are counted.
LENGTHS = (2, 3)
#: The classifier is fitted on about so many labelled documents (all, if there are fewer).
MAX_TRAIN_DOCS = 20_000
#: Evidence of a long text counts as that of so many n-grams, so that scores keep apart.
EVIDENCE = 60.0


def grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """By length, the buckets of the n-grams that start at each place (BUCKETS: none); where each text's places start; and
    whether a text has a letter. Letters are lower-cased, anything else counts as a separator."""
    points, heads = tx.code_points(texts)
    symbols = tx.letter_symbols()[points]
    # a separator before each text, and enough behind the last one
    line = np.zeros(len(points) + len(texts) + max(LENGTHS), np.uint32)
    line[np.arange(len(points)) + np.repeat(np.arange(1, len(texts) + 1), np.diff(heads))] = symbols
    size = len(points) + len(texts)
    out, h, some = [], np.zeros(size, np.uint32), np.zeros(size, bool)
    for i in range(max(LENGTHS)):
        h = h * np.uint32(0x01000193) + line[i : i + size]
        some = some | (line[i : i + size] != 0) if i else line[:size] != 0
        if i + 1 in LENGTHS:
            bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * i) >> np.uint32(16)).astype(np.int32)
            out.append(np.where(some, bucket, BUCKETS))
    bounds = heads + np.arange(len(heads))
    has = np.add.reduceat(line[:size] != 0, bounds[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    return out, bounds, has


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x BUCKETS + 1, the last for no n-gram

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not len(texts) or not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        buckets, bounds, letters = grams(texts)
        n = sum(np.add.reduceat(b != BUCKETS, bounds[:-1], dtype=np.int64) for b in buckets)
        total = np.empty((len(texts), len(self.languages)))
        for i, log_prob in enumerate(self.log_prob):
            by_place = log_prob[buckets[0]]
            for b in buckets[1:]:
                by_place += log_prob[b]
            total[:, i] = np.add.reduceat(by_place, bounds[:-1], dtype=np.float64)
        total = total * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None] + self.log_prior
        best = total.argmax(axis=1)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        score = np.where(letters, p.max(axis=1) / p.sum(axis=1), 0.0)
        return [self.languages[b] if has else "und" for b, has in zip(best, letters, strict=True)], score


def _counted(batches):
    for batch in batches:
        for part in tx.slices(batch):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            buckets, bounds, _ = grams(part.column("text"))
            for lang in sorted(set(langs)):
                own = np.repeat(langs == lang, np.diff(bounds))
                n = sum(np.bincount(b[own], minlength=BUCKETS + 1) for b in buckets)[:BUCKETS]
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(n[at], (langs == lang).sum()), pa.int64())], ["lang", "bucket", "n"])


def fit(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> LanguageModel:
    """Learn from (doc_id, text, lang) of documents that are not held out. Bucket -1 counts documents."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(usable.select("doc_id", "text", "lang"), "doc_id", max_train_docs, 7)
    counts = sample.select("text", "lang").mapInArrow(lean(_counted), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts.lang.unique())
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((0, BUCKETS + 1), np.float32))
    n, prior = np.full((BUCKETS, len(languages)), 0.1), np.zeros(len(languages))
    at = counts.lang.map({x: i for i, x in enumerate(languages)}).to_numpy()
    held, n_docs = counts.bucket.to_numpy(), counts.n.to_numpy()
    n[held[held >= 0], at[held >= 0]] += n_docs[held >= 0]
    prior[at[held < 0]] = n_docs[held < 0]
    none = np.zeros((len(languages), 1))
    return LanguageModel(languages, np.log(prior / prior.sum()), np.hstack([np.log(n / n.sum(axis=0)).T, none]).astype(np.float32))


def predict(spark: SparkSession, docs: DataFrame, model: LanguageModel, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its posterior probability; no other column is looked at."""
    held = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in (lang_col, score_col)]
    schema = T.StructType([*kept, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch):
                langs, score = held.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(langs, pa.string()), pa.array(score)], [*names, lang_col, score_col])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(lean(run), schema)
