"""Texts of an Arrow batch as numpy arrays: bytes, code points, words and their hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (their arrays stay in the processor's cache); one longer text makes a slice of its own.
SLICE_BYTES = 1 << 18


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each, so that temporary arrays stay small."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text starts (one more entry at the end). Null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and where each text starts."""
    data, offsets = utf8(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, heads[offsets]


@cache
def letter_symbols() -> np.ndarray:
    """By code point: the lower-case form of a letter, 0 for all else."""
    letter, lower = tables()
    return np.where(letter, lower, 0).astype(np.uint32)


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its lower-case form."""
    every = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = every.copy()
    for i in np.flatnonzero(letter[:0x3000]):
        if len(low := chr(i).lower()) == 1:
            lower[i] = ord(low)
    return letter, lower


def spread(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words [^\\x20\\x09-\\x0D]+ of all texts, and the number of words up to each text's start."""
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    inside = ~blank
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_kept: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**n, modulo 2**64; kept for texts of usual length."""
    had = _kept.get(int(base))
    if had is None or len(had) <= n:
        out = np.full(max(n, 2 * SLICE_BYTES) + 1, base, np.uint64)
        out[0] = 1
        had = np.multiply.accumulate(out)
        if n <= 4 * SLICE_BYTES:
            _kept[int(base)] = had
    return had[: n + 1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of words, from one running sum over all bytes (arithmetic modulo 2**64)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(_ODD, len(data)), _powers(_BACK, len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and where each text's runs start. A text of fewer words (but one) has its whole sequence as one run."""
    starts, ends, firsts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = np.diff(firsts)
    made = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    bounds = np.concatenate(([0], np.cumsum(made)))
    h = np.zeros(int(bounds[-1]), np.uint64)
    if not len(h):
        return h, bounds
    every = words[: max(len(words) - width + 1, 0)].copy()
    for i in range(1, width):
        every = every * _ODD + words[i : i + len(every)]
    every = mix(every)
    long = n >= width
    at = np.repeat(firsts[:-1], made) + spread(made)
    whole = np.repeat(long, made)
    h[whole] = every[at[whole]]
    for t in np.flatnonzero((n > 0) & ~long):
        x = np.zeros(1, np.uint64)
        for w in words[firsts[t] : firsts[t + 1]]:
            x = mix(x * _ODD + w + np.uint64(1))
        h[bounds[t]] = x[0]
    return h, bounds


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes, none across two texts, and the number of runs up to each text's start."""
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | first[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
