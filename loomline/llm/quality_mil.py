"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE code points. Every passage is encoded (tanh layer over hashed character pairs,
character classes and repetition measures), gated attention weighs the passages, and a logistic layer scores the weighted
representation. Weights are learned from document labels only.

Features of a bounded sample of labelled documents are made by Spark and fitted in numpy; scoring all documents is one
pass without a shuffle. Defined results: null and empty texts are one empty passage; without labels, or with labels of one
kind only, every score is that kind's share (0.5 without any); repeated rows are rows of their own; other columns pass
through untouched, and a column that clashes with a result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import texts as tx
from loomline.llm.shared import bounded_sample, held_out, lean

PASSAGE = 512
PAIRS = 256
CLASSES = 12
WIDTH = PAIRS + CLASSES + 4
#: The classifier is fitted on all passages of about so many labelled documents (all, if there are fewer).
MAX_TRAIN_DOCS = 6_000


@cache
def _kinds() -> np.ndarray:
    """By code point: a small number for its kind."""
    letter, lower = tx.tables()
    kind = np.full(len(letter), 11, np.int16)
    kind[letter] = np.where(lower[letter] == np.flatnonzero(letter), 0, 1)
    kind[48:58] = 2
    for k, marks in enumerate((" ", "\n\t\r", ".,;:", "!?", "'\"()-", "|", "#*$%&", "<>{}[]=/\\_@+~^`"), 3):
        kind[[ord(c) for c in marks]] = k
    return kind


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows), and where each text's passages start."""
    points, heads = tx.code_points(texts)
    n = np.maximum(1, -(-np.diff(heads) // PASSAGE))
    bounds = np.concatenate(([0], np.cumsum(n)))
    total = int(bounds[-1])
    row = np.repeat(np.arange(len(texts)), np.diff(heads))
    inside = np.arange(len(points)) - heads[:-1][row]
    at = bounds[:-1][row] + inside // PASSAGE
    size = np.maximum(np.bincount(at, minlength=total), 1).astype(np.float64)
    out = np.zeros((total, WIDTH), np.float32)
    if not len(points):
        return out, bounds
    kind = _kinds()[points]
    out[:, PAIRS : PAIRS + CLASSES] = np.sqrt(np.bincount(at * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES) / size[:, None])
    _, lower = tx.tables()
    low = lower[points]
    pair = (low[:-1] * np.uint32(0x01000193) + low[1:]) * np.uint32(0x9E3779B1) >> np.uint32(24)
    pair = np.where(at[:-1] == at[1:], at[:-1] * PAIRS + pair, total * PAIRS)  # none across passages
    counts = np.bincount(pair, minlength=total * PAIRS + 1)[:-1].reshape(total, PAIRS)
    share = counts / size[:, None]
    out[:, :PAIRS] = np.sqrt(share)
    # repetition: spread of the pairs, words equal to the word before, length of words, size of the passage
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, PAIRS + CLASSES] = -np.where(counts > 0, share * np.log(share), 0).sum(axis=1) / 5
    data, offsets = tx.utf8(texts)
    starts, ends, firsts = tx.word_spans(data, offsets)
    if len(starts):
        h = tx.word_hashes(data, starts, ends)
        owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        of = bounds[:-1][owner] + (chars[starts] - heads[:-1][owner]) // PASSAGE
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])))
        words = np.maximum(np.bincount(of, minlength=total), 1)
        out[:, PAIRS + CLASSES + 1] = np.bincount(of[again], minlength=total) / words
        out[:, PAIRS + CLASSES + 2] = np.log1p(size / words) / 3
    out[:, PAIRS + CLASSES + 3] = size / PASSAGE
    return out, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray] | None
    share: float

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        w, starts, n = self.w, bounds[:-1], np.diff(bounds)
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (v * u) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if self.w is None:
            return np.full(len(texts), self.share)
        x, bounds = passages(texts)
        return self.forward((x - self.mean) / self.scale, bounds)["p"].astype(np.float64)


def train(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 24, seed: int = 5) -> MilModel:
    """Adam on the log loss of bags; the rarer kind weighs more (up to 3 times)."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return MilModel(np.zeros(0), np.ones(0), None, share)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    w = {"W": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)), "a": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    model = MilModel(mean.astype(np.float32), scale.astype(np.float32), w, share)
    weight = np.where(y == 0, min(3.0, max(1.0, share / (1 - share))), min(3.0, max(1.0, (1 - share) / share)))
    m, s, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    size = 64
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            bags = order[at : at + size]
            n = np.diff(bounds)[bags]
            rows = np.repeat(bounds[bags], n) + tx.spread(n)
            b = np.concatenate(([0], np.cumsum(n)))
            xs, f = x[rows], model.forward(x[rows], b)
            d = ((f["p"] - y[bags]) * weight[bags] / len(bags)).astype(np.float32)
            g = {"c": f["z"].T @ d, "d": d.sum(keepdims=True)}
            dz = np.repeat(np.outer(d, w["c"]), n, axis=0)
            da = (dz * f["h"]).sum(axis=1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, b[:-1]), n))
            g["a"] = (f["v"] * f["u"]).T @ de
            dv, du = np.outer(de, w["a"]) * f["u"] * (1 - f["v"] ** 2), np.outer(de, w["a"]) * f["v"] * f["u"] * (1 - f["u"])
            g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
            dh = (dz * f["a"][:, None] + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
            g["W"], g["b"] = xs.T @ dh, dh.sum(axis=0)
            t += 1
            rate = 0.004 * (1 - 0.9 * epoch / epochs)
            for k, v in g.items():
                v = v + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def _encoded(batches):
    for batch in batches:
        for part in tx.slices(batch):
            x, bounds = passages(part.column("text"))
            for i, y in enumerate(part.column("quality").to_pylist()):
                own = x[bounds[i] : bounds[i + 1]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(i, 1).cast(pa.int64()), pa.array([y], pa.int64()), pa.array([own.astype(np.float16).tobytes()], pa.binary())], ["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> MilModel:
    """Learn `labels.quality` from whole texts of labelled documents that are not held out; a repeated id counts once, with
    the least text and label. The picked labels have a bounded number of rows, and so are broadcast."""
    usable = labels.where(~held_out() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("long").alias("quality"))
    picked = F.broadcast(bounded_sample(usable, "doc_id", max_train_docs, 6))
    once = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = once.mapInArrow(lean(_encoded), "doc_id long, y long, x binary").toPandas().sort_values(["doc_id", "y", "x"], kind="stable")
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH).astype(np.float32) for b in rows.x]
    return train(np.concatenate(bags or [np.zeros((0, WIDTH), np.float32)]), np.concatenate(([0], np.cumsum([len(b) for b in bags]))).astype(int), (rows.y.to_numpy() > 0).astype(np.float32))


def score(spark: SparkSession, docs: DataFrame, model: MilModel, score_col: str = "score") -> DataFrame:
    """docs with the probability of quality 1."""
    held = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != score_col]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(held.value.score(part.column("text")))], [*names, score_col])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(lean(run), T.StructType([*kept, T.StructField(score_col, T.DoubleType())]))
