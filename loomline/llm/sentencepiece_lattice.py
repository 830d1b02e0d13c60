"""SentencePiece encoding and decoding over a relational lattice.

Texts become runs (spaces are U+2581, one stands before the text; a run is spaces and what follows them, and no piece
reaches over its end). Words between spaces are counted, and up to MOST_RUNS of the most frequent ones make a dictionary:

1. they are exploded into all substrings of bounded length, these are equi-joined to the table of pieces (of a fixed size,
   so broadcast), and the edges are grouped by run: the lattice;
2. a fold over each lattice (Spark's `aggregate`) gives its segmentation. Unigram models: Viterbi, the path with the highest
   sum of scores. BPE models, whose scores are ranks of merges and for which the best sum isn't the library's result: the
   edges in order of rank (leftmost of equals), each of which joins two neighbouring parts if it spans exactly these. The
   boundaries are bits of a long, so a step costs the same at every length. One pass in this order equals the library's
   repeated choice of the best pair, because a piece's own merges never have a worse rank than the piece (checked for each
   model when it is read);
3. the dictionary, of a bounded size, is broadcast, and texts take their ids from it where they are read.

Runs that aren't in it (rare ones, and those of more than LONG characters, which don't fit into the bits: web addresses,
base64, scripts without spaces) are folded by the worker that meets them, with the same result: BPE by joining the
best of neighbouring pairs (long runs by a heap of them), unigram by Viterbi over bounded lengths, both in about linear time. No text is shuffled. Lattices of all runs by Spark
were measured and are far slower; figures are in the README.

Characters that no piece covers become byte pieces. Decoding looks up the pieces' bytes. Models must have the identity
normalizer, a space before the text and no removal of spaces. Defined results: null and empty texts have no ids and decode
to an empty text; repeated rows are documents of their own; an empty table gives no rows; extra columns are left out.
U+2581 itself decodes to a space, as in the library.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import Scratch, lean
from loomline.llm.texts import slices
from loomline.llm.token_orc import ids_array

#: The dictionary has up to so many runs; a worker remembers up to so many others.
MOST_RUNS, RARE_RUNS = 300_000, 100_000
LONG = 60
#: An edge's id has 20 bits; none has all of them set.
NO_ID = (1 << 20) - 1
NO_PIECE = 1e9
_RUN = "▁+[^▁]*"
_RUNS = re.compile(_RUN)


class PieceTable:
    """Pieces of a model file: texts, scores and bytes; small and of a fixed size."""

    def __init__(self, spark: SparkSession, model: str, kind: str = "bpe"):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.kind = kind
        self.longest = max(len(p.id_to_piece(i)) for i in plain)
        self.piece = {p.id_to_piece(i): (-float(p.get_score(i)), i) for i in plain}
        self.cost = {i: cost for cost, i in self.piece.values()}
        self.pair_cost = {x: cost for x, (cost, _) in self.piece.items()}.get
        self.first_byte = p.piece_to_id("<0x00>")
        self.raw = [bytes([i - self.first_byte]) if p.is_byte(i) else b"" if p.is_control(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        if n >= NO_ID or self.longest > LONG:
            raise ValueError("too many pieces, or too long ones")
        if kind == "bpe" and not all(self.ordered(x) for x in self.piece):
            raise ValueError("a piece of this model has a better rank than one of its own merges")
        rank = {cost: r for r, cost in enumerate(sorted(set(self.cost.values())))}
        self.rows = spark.createDataFrame([(x, i, rank[cost]) for x, (cost, i) in self.piece.items()], "piece string, id int, rank long")

    def __getstate__(self):  # what workers need
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def ordered(self, piece: str) -> bool:
        """Whether the merges that make the piece alone have ranks up to its own; or whether it is never made."""
        ranks: list[float] = []
        return len(self.fold(piece, ranks)) > 1 or not ranks or ranks == sorted(ranks)

    def short(self, run: str) -> list[str]:
        """Parts of a short run: the costs of all neighbouring pairs, the best of which is joined until none is a piece."""
        get, none = self.pair_cost, float("inf")
        parts = list(run)
        costs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def fold(self, run: str, ranks: list[float] | None = None) -> list[str]:
        """Parts of a run of any length, by a heap of neighbouring pairs (the best rank, then the leftmost)."""
        piece, n = self.piece, len(run)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and end[a] < n:
                b = end[end[a]]
                if b - a <= self.longest and (found := piece.get(run[a:b])):
                    heapq.heappush(heap, (found[0], a, b))

        for a in range(n):
            offer(a)
        alive = [True] * n
        while heap:
            cost, a, b = heapq.heappop(heap)
            if not alive[a] or end[a] >= b or end[end[a]] != b:
                continue
            if ranks is not None:
                ranks.append(cost)
            alive[end[a]] = False
            end[a] = after[a] = b
            if b < n:
                before[b] = a
            offer(a)
            offer(before[a])
        parts, a = [], 0
        while a < n:
            parts.append(run[a : end[a]])
            a = end[a]
        return parts

    def viterbi(self, run: str) -> list[str]:
        """Parts of the path with the least cost; a character without a piece costs more than any path of pieces."""
        cost, start = [0.0], [0]
        for k in range(1, len(run) + 1):
            ways = [(cost[j] + self.piece[run[j:k]][0], j) for j in range(max(0, k - self.longest), k) if run[j:k] in self.piece]
            best = min([*ways, (cost[k - 1] + NO_PIECE, k - 1)])
            cost.append(best[0])
            start.append(best[1])
        parts, k = [], len(run)
        while k:
            parts.append(run[start[k] : k])
            k = start[k]
        return parts[::-1]

    def long_ids(self, run: str) -> bytes:
        """Ids of a run, as little-endian 32-bit integers."""
        ids: list[int] = []
        for x in self.viterbi(run) if self.kind != "bpe" else self.short(run) if len(run) <= LONG else self.fold(run):
            if x in self.piece:
                ids.append(self.piece[x][1])
            else:
                ids += [self.first_byte + b for b in x.encode()]
        return array("i", ids).tobytes()

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def lattice(runs: DataFrame, table: PieceTable, *keys: str) -> DataFrame:
    """(keys, run, edges) of distinct runs of at most LONG characters: edges as longs of (rank, s, n, id), so by rank, then
    place; s counts from 0. Edges of one ASCII character are left out, a short table has them. Nothing is shuffled if runs
    are dealt by the keys."""
    at = runs.select(*keys, "run", F.explode(F.expr("sequence(0, length(run) - 1)")).alias("s"))
    sizes = F.expr(f"sequence(if(ascii(substring(run, s + 1, 1)) < 128, 2, 1), least({table.longest}, length(run) - s))")
    possible = F.expr("length(run) - s > 1 OR ascii(substring(run, s + 1, 1)) > 127")
    cut = at.where(possible).select(*keys, "run", "s", F.explode(sizes).alias("k")).withColumn("piece", F.expr("substring(run, s + 1, k)"))
    edges = cut.join(F.broadcast(table.rows), "piece").select(*keys, "run", F.expr("shiftleft(rank, 32) + shiftleft(CAST(s AS BIGINT), 26) + shiftleft(CAST(k AS BIGINT), 20) + id").alias("edge"))
    return edges.groupBy(*keys, "run").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


_S, _N, _ID = "CAST(shiftright(e, 26) & 63 AS INT)", "CAST(shiftright(e, 20) & 63 AS INT)", f"(e & {NO_ID})"
#: Boundaries of a run's parts are the bits m, from 0 to its length. These are the bits at an edge, its last one, and how all
#: bits of an edge look where it is one part.
_SEEN, _TOP = f"(shiftright(m, {_S}) & (shiftleft(1L, {_N} + 1) - 1))", f"shiftleft(1L, {_N})"
_BPE_MASK = f"""aggregate(edges, shiftleft(1L, length(run) + 1) - 1,
    (m, e) -> CASE WHEN bit_count({_SEEN}) = 3 AND {_SEEN} > {_TOP} AND {_SEEN} % 2 = 1 THEN m - shiftleft({_SEEN} - 1 - {_TOP}, {_S}) ELSE m END)"""


def _literal(values: list, kind: str) -> str:
    return "from_json('" + json.dumps(values) + f"', 'array<{kind}>')"


def _viterbi_mask(table: PieceTable) -> str:
    costs = _literal([table.cost.get(i, NO_PIECE) for i in range(len(table.raw))], "double")
    single = _literal([table.piece.get(chr(i), (NO_PIECE, 0))[0] for i in range(128)], "double")
    ways = f"transform(filter(edges, e -> {_S} + {_N} = k), e -> struct(best[{_S}].cost + element_at({costs}, CAST({_ID} AS INT) + 1) AS cost, {_S} AS s))"
    one = f"array(struct(best[k - 1].cost + coalesce(try_element_at({single}, ascii(substring(run, k, 1)) + 1), {NO_PIECE}D) AS cost, k - 1 AS s))"
    start = "array(struct(CAST(0.0 AS DOUBLE) AS cost, 0 AS s))"
    best = f"aggregate(sequence(1, length(run)), {start}, (best, k) -> concat(best, array(array_min(concat({ways}, {one})))))"
    # best[k].s: where the last piece of the best path to k begins; followed back from the end
    back = "aggregate(sequence(1, length(run)), struct(length(run) AS at, shiftleft(1L, length(run)) AS m), (c, k) -> CASE WHEN c.at = 0 THEN c ELSE struct(b[c.at].s AS at, c.m | shiftleft(1L, b[c.at].s) AS m) END).m"
    return f"transform(array({best}), b -> {back})[0]"


def dictionary(runs: DataFrame, table: PieceTable, *keys: str) -> DataFrame:
    """(keys, run, ids) of distinct runs of at most LONG characters that hold a piece of two characters or more, or one
    beyond ASCII; other runs are so short that a worker makes them where it meets them."""
    mask = _BPE_MASK if table.kind == "bpe" else _viterbi_mask(table)
    single = _literal([table.piece.get(chr(i), (0, NO_ID))[1] for i in range(128)], "bigint")
    wide = f"transform(filter(edges, e -> {_SEEN} = {_TOP} + 1), e -> shiftleft(shiftright(e, 26) & 63, 20) + {_ID})"
    narrow = f"transform(filter(sequence(0, length(run) - 1), i -> shiftright(m, i) & 3 = 3 AND ascii(substring(run, i + 1, 1)) < 128), i -> shiftleft(CAST(i AS BIGINT), 20) + element_at({single}, ascii(substring(run, i + 1, 1)) + 1))"
    as_bytes = f"transform(filter(split(hex(encode(substring(run, i + 1, 1), 'UTF-8')), '(?<=\\\\G..)'), x -> x <> ''), x -> CAST(conv(x, 16, 10) AS INT) + {table.first_byte})"
    found = f"try_element_at(transform(filter(p, x -> shiftright(x, 20) = i AND x & {NO_ID} <> {NO_ID}), x -> array(CAST(x & {NO_ID} AS INT))), 1)"
    each = f"flatten(transform(filter(sequence(0, length(run) - 1), i -> shiftright(m, i) & 1 = 1), i -> coalesce({found}, {as_bytes})))"
    whole = f"CASE WHEN size(p) < bit_count(m) - 1 OR exists(p, x -> x & {NO_ID} = {NO_ID}) THEN {each} ELSE transform(p, x -> CAST(x & {NO_ID} AS INT)) END"
    ids = f"transform(array({mask}), m -> transform(array(sort_array(concat({wide}, {narrow}))), p -> {whole})[0])[0]"
    return lattice(runs.where(f"length(run) BETWEEN 1 AND {LONG}"), table, *keys).select(*keys, "run", F.expr(ids).alias("ids"))


def frequent(docs: DataFrame, most: int) -> DataFrame:
    """Up to `most` of the most frequent runs of one space and at most LONG characters: whole levels of frequency, from the top."""
    level = F.floor(F.log2("n") * 8).cast("int")
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    runs = words.where(f"n > 1 AND word <> '' AND length(word) < {LONG} AND NOT contains(word, '▁')").select(F.concat(F.lit("▁"), "word").alias("run"), "n")
    counted = Scratch(docs.sparkSession, "runs").keep(runs.withColumn("level", level), "counted")
    least, held = 1 << 20, 0
    for r in sorted(counted.groupBy("level").agg(F.count("*").alias("runs")).collect(), key=lambda r: -r.level):  # some 300 levels at most
        held += r.runs
        if held > most:
            break
        least = r.level
    return counted.where(F.col("level") >= least).select("run")


class RunTable:
    """Ids of runs, as Arrow columns on the driver and on the way; a worker makes a dict of them once."""

    def __init__(self, words: pa.Table):
        self.words, self.known = words, None

    def by_run(self) -> dict[str, bytes]:
        if self.known is None:
            self.known = {}
            for batch in self.words.to_batches():
                ids = batch.column("ids")
                flat, at = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype("<i4").tobytes(), 0
                for run, n in zip(batch.column("run").to_pylist(), pc.list_value_length(ids).to_pylist(), strict=True):
                    self.known[run] = flat[at : at + 4 * n]
                    at += 4 * n
            self.words = None
        return self.known


def encode(docs: DataFrame, table: PieceTable, most: int = MOST_RUNS) -> DataFrame:
    """(doc_id, text, ids) of whole texts."""
    words = dictionary(frequent(docs, most).repartition("run"), table).toArrow().combine_chunks()  # a bounded number of rows
    held = docs.sparkSession.sparkContext.broadcast((table, RunTable(words)))

    def run(batches):
        own, known = held.value[0], held.value[1].by_run()
        rare: dict[str, bytes] = {}
        for batch in batches:
            for part in slices(batch):
                out = []
                for text in part.column("text").to_pylist():
                    cut = _RUNS.findall("▁" + text.replace(" ", "▁")) if text else []
                    try:
                        out.append(b"".join(map(known.__getitem__, cut)))
                    except KeyError:
                        if len(rare) > RARE_RUNS:
                            rare.clear()
                        out.append(b"".join([known.get(r) or rare.get(r) or rare.setdefault(r, own.long_ids(r)) for r in cut]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), ids_array(out)], ["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, table: PieceTable, text_col: str = "decoded") -> DataFrame:
    """(doc_id, text, ids) with the text of the ids; bytes that are no UTF-8 become U+FFFD."""
    held = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            made = [held.value.text(x.values.to_numpy(zero_copy_only=False)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, text_col])

    return encoded.select("doc_id", "text", "ids").mapInArrow(lean(run), f"doc_id long, text string, ids array<int>, {text_col} string")


def digest(encoded: DataFrame, table: PieceTable) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip); it decodes as `decode` does, without a worker more for each task."""
    held = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            ids = [x.values.to_numpy(zero_copy_only=False).astype("<u4") for x in batch.column("ids")]
            same = [(t or "").replace("▁", " ") == held.value.text(x) for t, x in zip(batch.column("text").to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return encoded.select("doc_id", "text", "ids").mapInArrow(lean(run), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
