"""Packing of documents into sequences by best fit, longest first.

Documents are encoded, an end id is appended, and overlong ones are first cut into full windows. The other pieces of a
block (BLOCK_TOKENS of one input partition) go, longest first, to the open window with the least sufficient room, which a
segment tree over the remaining capacities finds. Windows that stay short of full then give up their pieces to fill the
gaps of fuller ones (cut where needed), and the last of them is cut into powers of two, which need no padding.

Blocks are packed where they are read: no shuffle, and memory is bounded by a block. Defined results: a null or empty text
is the end id alone; repeated rows are documents of their own; an empty table gives no pieces; extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomline.llm.bpe import MAX_WORDS, encoder
from loomline.llm.shared import lean
from loomline.llm.token_orc import ids_array

LENGTH = 1024
#: Ids packed together; the text behind them has some tens of MB.
BLOCK_TOKENS = 4 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"


class CapacityTree:
    """Open windows by remaining capacity 1..size. A node holds how many windows its range of capacities has."""

    def __init__(self, size: int):
        self.leaves = 1 << (size - 1).bit_length() + 1
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        at = self.leaves + capacity
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (window, capacity) of the tightest window with at least this capacity."""
        at = self.leaves + least
        while not self.count[at]:
            while at & 1:  # up, until a range to the right is next
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        window = self.windows[capacity].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return window, capacity


def pack(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces for documents of these sizes."""
    windows: list[list[tuple[int, int, int]]] = []
    rest = []
    for i, n in enumerate(sizes):
        windows += [[(i, a, length)] for a in range(0, n - length + 1, length)]
        if n % length:
            rest.append((n % length, i, n - n % length))
    open_windows, tree = [], CapacityTree(length)
    for n, i, a in sorted(rest, key=lambda x: (-x[0], x[1])):
        found = tree.take(n)
        if found is None:
            found = len(open_windows), length
            open_windows.append([])
        window, capacity = found
        open_windows[window].append((i, a, n))
        if capacity > n:
            tree.add(capacity - n, window)
    filled = sorted(open_windows, key=lambda w: -sum(n for _, _, n in w))
    fill = [sum(n for _, _, n in w) for w in filled]
    low, high = 0, len(filled) - 1
    while low < high:  # the emptiest window fills the gaps of the fullest
        gap = length - fill[low]
        if not gap:
            low += 1
            continue
        i, a, n = filled[high].pop()
        k = min(gap, n)
        filled[low].append((i, a, k))
        fill[low] += k
        fill[high] -= k
        if k < n:
            filled[high].append((i, a + k, n - k))
        if not filled[high]:
            high -= 1
    for w, n in zip(filled, fill, strict=True):
        if n in (0, length):
            windows += [w] if w else []
            continue
        bits = [1 << b for b in reversed(range(length.bit_length())) if n >> b & 1]
        for size in bits:
            part: list[tuple[int, int, int]] = []
            while size:
                i, a, k = w.pop()
                use = min(k, size)
                part.append((i, a, use))
                size -= use
                if use < k:
                    w.append((i, a + use, k - use))
            windows.append(part)
    return windows


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, max_words: int = MAX_WORDS) -> DataFrame:
    """All pieces with their ids, and where they lie. max_words bounds the words that a worker remembers (about 200 bytes each)."""
    end = int(end_id).to_bytes(4, "little")

    def packed(ids: list[int], raw: list[bytes], first: int):
        sizes = [len(b) // 4 for b in raw]
        windows = pack(sizes, length)
        rows = [(i, a, n, first + w, o) for w, parts in enumerate(windows) for (i, a, n), o in zip(parts, np.cumsum([0] + [p[2] for p in parts]), strict=False)]
        for at in range(0, len(rows), 2048):
            i, a, n, w, o = (list(c) for c in zip(*rows[at : at + 2048], strict=True))
            cut = [raw[j][4 * x : 4 * (x + k)] for j, x, k in zip(i, a, n, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in i], pa.int64()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array([sizes[j] for j in i], pa.int64()), pa.array(w, pa.int64()), pa.array(np.array(o, np.int64)), ids_array(cut)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        return len(windows)

    def run(batches):
        encode, next_id = encoder(tokenizer, max_words).encode, TaskContext.get().partitionId() << 36
        ids, raw, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw.append(encode(text.as_py() or "") + end)
                ids.append(doc_id)
                held += len(raw[-1]) // 4
                if held >= block_tokens:
                    next_id += yield from packed(ids, raw, next_id)
                    ids, raw, held = [], [], 0
        if raw:
            yield from packed(ids, raw, next_id)

    return docs.select("doc_id", "text").mapInArrow(lean(run), SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids instead of the ids."""
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            crc = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    return packed.mapInArrow(lean(run), ", ".join(f"{c} long" for c in [*names, "ids_crc32"]))
