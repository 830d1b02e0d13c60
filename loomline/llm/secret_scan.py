"""Secrets in texts: fixed patterns, and tokens that look random to a pair of character Markov models.

One model learns from random strings (hexadecimal, base64, letters with digits), the other from ordinary identifiers and
words; a token of MIN_TOKEN characters or more is a secret where the log-likelihood ratio is high in all and by character.
The random strings are drawn with a fixed seed; the ordinary ones are fixed identifiers plus the tokens of all documents,
without what the patterns find. Scanning is one pass without a shuffle; spans are in code points.

Defined results: a null or empty text has no spans; without any documents only the fixed identifiers are learned;
repeated rows are rows of their own; other columns pass through untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.shared import lean

KINDS = ("assign", "access", "hex", "random")
#: Tokens have this many characters at least; shorter ones carry too little evidence.
MIN_TOKEN = 16
#: A token counts as random from these log-likelihood ratios (natural logarithm), in all and a character.
MIN_RATIO, MIN_RATE = 20.0, 0.7

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of the class is matched whole, so its least length can stand in the pattern
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORD = re.compile(r"[A-Za-z0-9+/_-]{8,}")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}={{0,2}}")

#: Fixed parts of ordinary identifiers.
IDENTIFIERS = """
get set find make build parse read write open close user name file path line text value index count total list map key
node item table column row batch page token request response error message handler manager service client server config
option default string number integer float double array buffer stream reader writer parser factory builder context session
version release module package import export function method class object property attribute element document window
width height length size start stop begin first last next previous current update delete insert select query filter
image video audio content header footer button click event listener callback async await promise http https www com org
""".split()

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
_CODE = np.full(128, len(_ALPHABET), np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
STATES = len(_ALPHABET) + 1  # the last also stands before the first character


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def _counts(tokens: list[str]) -> np.ndarray:
    """How often a state follows another; a line break between tokens is the state before the first character."""
    codes = _CODE[np.frombuffer(("\n" + "\n".join(tokens)).encode("ascii"), np.uint8)]
    n = np.bincount(codes[:-1] * STATES + codes[1:], minlength=STATES * STATES).reshape(STATES, STATES).astype(float)
    n[:, STATES - 1] = 0
    return n


def _logs(n: np.ndarray, smooth: float) -> np.ndarray:
    return np.log((n + smooth) / (n + smooth).sum(axis=1, keepdims=True))


def labelled_random(n: int = 4000, seed: int = 11) -> list[str]:
    """Random strings of the usual alphabets."""
    rng = np.random.default_rng(seed)
    kinds = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _ALPHABET[:62], _ALPHABET[:64], _ALPHABET[:62] + "_-")
    return ["".join(rng.choice(list(kinds[i % len(kinds)]), rng.integers(16, 48))) for i in range(n)]


def labelled_ordinary(n: int = 4000, seed: int = 12) -> list[str]:
    """Identifiers of fixed parts: snake, kebab and camel case, capitals, paths, numbered names."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        parts = [str(x) for x in rng.choice(IDENTIFIERS, rng.integers(2, 5))]
        joint = ("_".join(parts), "-".join(parts), parts[0] + "".join(p.title() for p in parts[1:]), "_".join(parts).upper(), "/".join(parts), "_".join(parts) + str(rng.integers(0, 2030)))
        out.append(joint[i % len(joint)])
    return out


@dataclass
class MarkovPair:
    ratio: np.ndarray  # log-likelihood ratio of each pair of states

    def random(self, tokens: list[str]) -> np.ndarray:
        """Which tokens look random."""
        if not tokens:
            return np.zeros(0, bool)
        size = np.array([len(t) for t in tokens])
        codes = _CODE[np.frombuffer("".join(tokens).encode("ascii"), np.uint8)]
        before = np.concatenate(([STATES - 1], codes[:-1]))
        starts = np.cumsum(size) - size
        before[starts] = STATES - 1
        total = np.add.reduceat(self.ratio[before, codes], starts)
        return (total >= MIN_RATIO) & (total >= MIN_RATE * size)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """All spans of each text."""
        out, found, tokens = [], [], []
        for i, text in enumerate(texts):
            base = base_spans(text)
            out.append(base)
            for m in _TOKEN.finditer(text):
                if not any(a < m.end() and m.start() < b for _, a, b in base):
                    found.append((i, m.start(), m.end()))
                    tokens.append(m[0])
        for (i, a, b), is_random in zip(found, self.random(tokens), strict=True):
            if is_random:
                out[i].append((3, a, b))
        return out


def _ordinary_pairs(batches):
    for batch in batches:
        tokens = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            if base := base_spans(text):
                tokens += [m[0] for m in _WORD.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in base)]
            else:
                tokens += _WORD.findall(text)
        n = _counts(tokens)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n.ravel()[at].astype(np.int64))], ["pair", "n"])


def fit(docs: DataFrame) -> MarkovPair:
    """Both models; what comes to the driver is at most STATES * STATES counts."""
    pairs = docs.select("text").mapInArrow(lean(_ordinary_pairs), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    ordinary = _counts(labelled_ordinary())
    here = np.zeros(STATES * STATES)
    here[pairs.pair.to_numpy()] = pairs.n.to_numpy()
    here *= ordinary.sum() / max(here.sum(), 1)  # as much weight as the fixed identifiers have
    return MarkovPair(_logs(_counts(labelled_random()), 0.5) - _logs(ordinary + here.reshape(STATES, STATES), 0.5))


def scan(spark: SparkSession, docs: DataFrame, model: MarkovPair, spans_col: str = "secret_spans") -> DataFrame:
    """docs with an array of (kind, start, end) spans, by start, then by kind."""
    held = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != spans_col]
    names = [f.name for f in kept]
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = held.value.spans([t or "" for t in batch.column("text").to_pylist()])
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(s, key=lambda x: (x[1], x[0], x[2]))] for s in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, arrow)], [*names, spans_col])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(lean(run), T.StructType([*kept, T.StructField(spans_col, kind)]))


def redact(docs: DataFrame, spans_col: str = "secret_spans", mark: str = "[SECRET]") -> DataFrame:
    """Texts with each span (overlapping ones as one) replaced by a mark; n_chars follows where there is one."""
    pieces = F.expr(f"""aggregate({spans_col}, struct('' AS done, CAST(0 AS BIGINT) AS at),
        (s, x) -> CASE WHEN x.end <= s.at THEN s
                       WHEN x.start < s.at THEN struct(s.done AS done, x.end AS at)
                       ELSE struct(s.done || substring(text, CAST(s.at + 1 AS INT), CAST(x.start - s.at AS INT)) || '{mark}' AS done, x.end AS at) END,
        s -> s.done || substring(text, CAST(s.at + 1 AS INT)))""")
    out = docs.withColumn("text", F.when(F.size(spans_col) > 0, pieces).otherwise(F.col("text"))).drop(spans_col)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
