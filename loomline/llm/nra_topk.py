"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors become integers, are dealt into blocks of BLOCK candidates, and meet blocks of queries (blocks times blocks, each
in a task of its own). A block has a list for each dimension, sorted once for all queries: candidates by that component. A
query reads each list from its better end (the high one where its own component is positive), a stretch of all lists at a
time, each stretch as deep as all before it together. What has been read of a candidate gives its bounds: the sum of its
components read, plus, for each list in which it is still unread, the worst value of that list (lower bound) or the value at
which the list stands (upper bound). Sums are made from the entries read alone, for many queries at once. Reading stops when
the k-th best lower bound is over what an outsider can reach, the sum of the values at which all lists stand; seen candidates
with an upper bound under it are given up, and the scores of the others are resolved from their vectors. Each block gives k
rows a query, and the k best of all blocks are ranked.

Integers are exact: bounds and scores are computed in float64 where no sum can exceed 2**53, in 64-bit integers up to 2**63,
and larger ones raise an error.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor does an empty vector;
vectors with the same vec_id as the query are its own; equal rows (same id, same vector) are counted before the shuffle and
come back as often as they are there; repeated query rows are one query, and different vectors under one query id are
different queries whose results are ranked together; vectors of another length than the query's are no candidates; extra
columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
#: Entries read of each list before the bounds are first looked at; doubled each time.
STRETCH = 128
BLOCK = 8_192
#: Queries that read the lists of a block together.
TOGETHER = 128
QUERY_BLOCK = 2_048
RESULT = "query_id long, vec_id long, score long, n long"


def quantized(embeddings: DataFrame) -> DataFrame:
    """(vec_id, q, n): integer components, and how often the row is there."""
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("embedding IS NOT NULL AND vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) < double('infinity'))")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return usable.select("vec_id", whole.alias("q")).groupBy("vec_id", "q").agg(F.count("*").alias("n"))


class SortedLists:
    """The lists of a block: for each dimension, the places of the candidates by that component, ascending."""

    def __init__(self, candidates: np.ndarray, kind: type):
        self.order = np.argsort(candidates, axis=0, kind="stable")
        self.values = np.take_along_axis(candidates, self.order, axis=0).astype(kind)
        self.n, self.width = candidates.shape

    def read(self, depth: int, high: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the entries at one end of all lists, down to a depth: which they are, their values, and where the lists stand."""
        rows = slice(self.n - depth, self.n) if high else slice(0, depth)
        at, dim = self.order[rows], np.arange(self.width)
        seen, value = np.zeros((self.n, self.width), self.values.dtype), np.zeros((self.n, self.width), self.values.dtype)
        seen[at, dim], value[at, dim] = 1, self.values[rows]
        return seen, value, self.values[self.n - depth if high else depth - 1]


def exact_kind(candidates: np.ndarray, queries: np.ndarray) -> type:
    """The type in which no sum of products, in any order, is inexact."""
    most = max((abs(int(x)) for x in (candidates.max(), candidates.min())), default=0) * max(abs(int(x)) for x in (queries.max(), queries.min())) * candidates.shape[1]
    if most >= 2**63:
        raise ArithmeticError("inner products may exceed 64 bits")
    return np.float64 if most < 2**53 else np.int64


def block_top(candidates: np.ndarray, ids: np.ndarray, counts: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, entries: list[int] | None = None):
    """(query_id, vec_id, score, n) of each query's k best candidates of a block. entries gets the number of entries read."""
    kind = exact_kind(candidates, queries)
    lists, n = SortedLists(candidates, kind), len(candidates)
    worst_high, worst_low = lists.values[0], lists.values[-1]
    for first in range(0, len(queries), TOGETHER):
        left = np.arange(first, min(first + TOGETHER, len(queries)))
        depth = min(STRETCH, n)
        while len(left):
            q = queries[left].astype(kind)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            (seen_up, value_up, stand_up), (seen_down, value_down, stand_down) = lists.read(depth, True), lists.read(depth, False)
            known = value_up @ up.T + value_down @ down.T
            # what the unread lists hold at worst and at best: that of all lists, less that of those read
            lower = known + (up @ worst_high + down @ worst_low) - (seen_up @ (up * worst_high).T + seen_down @ (down * worst_low).T)
            outside = up @ stand_up + down @ stand_down
            upper = known + outside - (seen_up @ (up * stand_up).T + seen_down @ (down * stand_down).T)
            seen = (seen_up @ (up > 0).astype(kind).T + seen_down @ (down < 0).astype(kind).T) > 0
            on = []
            for i, query in enumerate(left):
                may = np.flatnonzero((seen[:, i] | (depth == n)) & (ids != query_ids[query]))
                least = lower[may, i]
                floor = np.partition(least, len(least) - k)[len(least) - k] if len(least) >= k else None
                if depth < n and (floor is None or outside[i] >= floor):
                    on.append(query)
                    continue
                if entries is not None:
                    entries.append(depth * int(np.count_nonzero(queries[query])))
                if floor is not None:
                    may = may[upper[may, i] >= floor]
                score = candidates[may] @ queries[query]  # resolved, in 64-bit integers
                for at in np.lexsort((ids[may], -score))[:k]:
                    yield query_ids[query], ids[may[at]], int(score[at]), counts[may[at]]
            left, depth = np.array(on, int), min(2 * depth, n)


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query vector, ties to smaller ids."""
    rows, asked = quantized(embeddings), quantized(queries).select(F.col("vec_id").alias("query_id"), "q")
    # a proven size of the grid: the blocks follow from the counts, and both sides are dealt by hash
    n_blocks = max(1, -(-embeddings.count() // block))
    n_query_blocks = max(1, -(-queries.count() // query_block))
    left = rows.select("vec_id", "q", "n", F.pmod(F.xxhash64("vec_id", "q"), F.lit(n_blocks)).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query_blocks - 1).cast("long"))).alias("qb"))
    right = asked.select("query_id", "q", F.pmod(F.xxhash64("query_id", "q", F.lit(1)), F.lit(n_query_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("b"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            length, wanted = a.q.map(len), b.q.map(len)
            for d in sorted(set(wanted) & set(length)):
                own, of = a[length == d], b[wanted == d]
                out += block_top(np.stack(own.q), own.vec_id.to_numpy(), own.n.to_numpy(), np.stack(of.q), of.query_id.to_numpy(), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "n"]).astype("int64")

    found = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInPandas(meet, RESULT)
    # rows that are there more than once: at most k of them can count
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
