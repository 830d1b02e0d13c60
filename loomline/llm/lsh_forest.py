"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. One pass makes each document's set of WIDTH-word shingles, its size, a digest of the full set and trees * DEPTH MinHash
   values. Documents with equal sets are one class from then on (sets are compared by a 128-bit digest of all elements);
   its smallest doc_id stands for it.
2. The forest: orders of the classes, one a tree, each sorted by its own DEPTH values (range partitions, so no group has to
   fit into a task). Classes that agree in a tree's first LEAST_DEPTH values share a region. In each order, a class is linked
   to the NEAR rows before it in its region, which have the longest common prefixes of those before it, and to the region's
   first. Of its neighbours, the BEST with the most common values over all trees are confirmed on full sets, and links give
   components. Then, in regions that hold more than one component, the class with the most links so far (the original of many
   copies, say, which are less like each other) is confirmed with each class of another component, PIVOTS times.
3. Depth adapts to the region: classes that agree in a tree's first SHALLOW values are candidates as well where no more than
   FEW share them; where more do, those that agree in one value more, again up to FEW, and so on to LEAST_DEPTH. The same
   pass over the sorted orders finds them (but for a group that the end of a range cuts). Candidates of two components whose
   sizes and sketches (a bit of each MinHash value) allow the threshold are confirmed.
4. What that leaves open: regions that hold classes of more than one component. There, all pairs across components whose
   signatures allow the threshold are confirmed too, where they meet (a pair only in its first common tree, and a region
   larger than REGION in blocks that meet in pairs), so that nothing but links comes out. Signatures meet first, and texts
   only of classes that have a partner then.
   So every pair that shares a region in any tree and whose signatures allow it is confirmed, or lies in one component already.

The number of trees follows from the threshold: a pair at similarity p = percent / 100 shares no region of LEAST_DEPTH with a
probability of (1 - p**LEAST_DEPTH)**trees, which is at most MISS (16 trees at 85 percent, 24 at 80); shallower prefixes only
lower it. Signatures and sketches exclude a pair at p with a probability of at most UNLIKELY each. Links are always confirmed
on the full sets.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a text of fewer words than WIDTH is one shingle. Defined results: null
and empty texts have no shingles and stand alone; rows with the same doc_id are one node, each row keeps its own
n_shingles; of rows with the same doc_id and set of shingles, one is kept; rows with a null doc_id stand outside the graph, with
a null component_id, and are kept; an empty table gives no rows; extra columns are left out. distinct_documents decides by
row instead, whatever the ids: see there.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm import texts as tx
from loomline.llm.components import components, merged
from loomline.llm.shared import Scratch, lean

DEPTH, LEAST_DEPTH, SHALLOW = 8, 5, 3
MISS, UNLIKELY = 1e-4, 1 / 30_000
NEAR, BEST, PIVOTS = 3, 2, 2
FEW, REGION = 8, 1_024
SKETCH = 128

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trees_for(percent: int) -> int:
    """The least number of trees that misses a pair at the threshold with a probability of at most MISS."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    together = (percent / 100) ** LEAST_DEPTH
    return 1 if together == 1 else math.ceil(math.log(MISS) / math.log1p(-together))


def least_equal(n: int, p: float) -> int:
    """The largest k such that fewer than k of n values that agree with probability p have a probability of at most UNLIKELY."""
    if p >= 1:
        return n
    below = 0.0
    for k in range(n + 1):
        below += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        if below > UNLIKELY:
            return k
    return n


@functools.cache
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(2024).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = tx.utf8(texts)
    h, bounds = tx.shingles(_LOWER[data], offsets, width)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        s = np.sort(h[a:b])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if b > a else s)
    return out


def signatures(distinct: list[np.ndarray], n: int) -> np.ndarray:
    """n MinHash values (rows: texts) of non-empty sets."""
    if not distinct:
        return np.zeros((0, n), np.uint32)
    flat = np.concatenate(distinct)
    starts = np.cumsum([0] + [len(s) for s in distinct])[:-1]
    out = np.empty((len(distinct), n), np.uint32)
    for i, factor in enumerate(_factors(n)):
        out[:, i] = np.minimum.reduceat(flat * factor, starts) >> np.uint64(32)
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """The lowest bits of the first SKETCH values, as two signed words."""
    bits = np.zeros((len(sig), SKETCH), np.uint8)
    bits[:, : sig.shape[1]] = sig[:, :SKETCH] & 1
    return np.packbits(bits, axis=1).view(np.int64)


def _signed(width: int, trees: int):
    def run(batches):
        for batch in batches:
            for part in tx.slices(batch):
                own = sets(part.column("text"), width)
                has = np.array([len(s) > 0 for s in own], bool)
                values = signatures([s for s in own if len(s)], trees * DEPTH)
                bits = np.zeros((len(own), 2), np.int64)
                bits[has] = sketches(values)
                sig = iter(values.astype(">u4"))
                n = pa.array([len(s) for s in own], pa.int64())
                digest = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in own], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), n, digest, pa.array([next(sig).tobytes() if len(s) else None for s in own], pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1])], ["doc_id", "n_shingles", "digest", "sig", "bits_1", "bits_2"])

    return run


def _forest_pairs(percent: int, trees: int):
    """A function of the sorted rows of a range of the forest: candidate pairs (x, y, common, near, sparse) whose sizes and
    sketches allow the threshold. near: y is one of the NEAR rows before x in its region, or the region's first; sparse: a
    prefix of SHALLOW values or more is shared by FEW rows at most. Rows are read in stretches; what is held over is the
    region's first row and the last FEW + 1."""
    used = min(SKETCH, trees * DEPTH)
    most = used - least_equal(used, (1 + percent / 100) / 2)
    columns = ("tree", "node", "n", "bits_1", "bits_2")

    def pairs(rows: dict[str, np.ndarray], lead: int, last: bool):
        """Pairs of rows (the first `lead` of them have been seen), and which rows to hold over."""
        key, tree, n = rows["key"], rows["tree"], rows["n"]
        at = np.arange(len(tree))
        split = lambda d: np.concatenate(([True], (tree[1:] != tree[:-1]) | (key[1:, :d] != key[:-1, :d]).any(axis=1)))
        head = np.maximum.accumulate(np.where(split(LEAST_DEPTH), at, 0))
        found = []
        for back in range(NEAR + 1):
            to = head if not back else at - back
            use = at[(at >= lead) & (to >= head) & (to < at) & ((back == 0) | (to > head))]
            found.append((use, to[use], np.ones(len(use), bool)))
        dense, open_before = np.ones(len(at), bool), np.zeros(len(at), bool)
        for d in range(SHALLOW, LEAST_DEPTH):
            new = split(d)
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            end = np.cumsum(size)
            ended = last | (end < len(at))
            # not given before: it hadn't ended, or wasn't known to lie in a dense one
            few = dense & (ended & (size <= FEW))[group] & ((end >= lead)[group] | open_before)
            dense &= (size > FEW)[group]
            open_before |= ((end >= lead) & (np.bincount(group[:lead], minlength=len(size)) <= FEW))[group]
            for back in range(1, min(FEW, len(at))):
                use = at[back:][few[back:] & (group[back:] == group[: len(at) - back])]
                found.append((use, use - back, np.zeros(len(use), bool)))
        x, y, near = (np.concatenate(c) for c in zip(*found, strict=True))
        apart = np.bitwise_count(rows["bits_1"][x] ^ rows["bits_1"][y]).astype(np.int64) + np.bitwise_count(rows["bits_2"][x] ^ rows["bits_2"][y])
        ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (apart <= most) & (rows["node"][x] != rows["node"][y])
        x, y, near = x[ok], y[ok], near[ok]
        common = np.logical_and.accumulate(key[x] == key[y], axis=1).sum(axis=1)
        hold = at[-(FEW + 1) :]
        if len(at) and head[-1] < hold[0]:
            hold = np.concatenate((head[-1:], hold))
        return pa.RecordBatch.from_arrays([pa.array(rows["node"][x]), pa.array(rows["node"][y]), pa.array(common.astype(np.int64)), pa.array(near.astype(np.int32)), pa.array((~near).astype(np.int32))], ["x", "y", "common", "near", "sparse"]), hold

    def run(batches):
        held, lead = None, 0
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in columns}
            rows["bits_1"], rows["bits_2"] = rows["bits_1"].view(np.uint64), rows["bits_2"].view(np.uint64)
            rows["key"] = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(-1, DEPTH)
            if held is not None:
                rows = {c: np.concatenate((held[c], rows[c])) for c in rows}
            if not len(rows["tree"]):
                continue
            out, hold = pairs(rows, lead, False)
            yield out
            held, lead = {c: v[hold] for c, v in rows.items()}, len(hold)
        if held is not None:  # the group at the end
            yield pairs(held, lead, True)[0]

    return run


def _with_text(rows: DataFrame, pairs: DataFrame, involved: DataFrame, side: str, other: str) -> DataFrame:
    """rows (those of the pairs, maybe with more columns) with text_<side>. An id that many pairs share is dealt out: it has
    more than a thousandth of all pairs, so there are no more than 2,000 such ids, and their table is broadcast."""
    part = max(1_000, pairs.count() // 1_000)
    hot = F.broadcast(pairs.groupBy(side).agg(F.ceil(F.count("*") / part).cast("int").alias("_parts")).where("_parts > 1"))
    dealt = rows.join(hot, side, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(other), "_parts"), F.lit(0)).cast("bigint")).drop("_parts")
    texts = involved.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")).join(hot, side, "left")
    texts = texts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1).cast("array<bigint>"))).drop("_parts")
    return dealt.join(texts, [side, "_part"]).drop("_part")


def _confirm(scratch: Scratch, involved: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b) with 100 * intersection >= percent * union of full sets."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keep = []
                for s, t in zip(sets(part.column("text_a"), width), sets(part.column("text_b"), width), strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = scratch.keep(pairs.select("a", "b"), "pairs")
    both = _with_text(_with_text(pairs, pairs, involved, "a", "b"), pairs, involved, "b", "a")
    return scratch.keep(both.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long"), "links")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    scratch, trees = Scratch(spark, "lsh"), trees_for(percent)
    signed = scratch.keep(docs.select("doc_id", "text").mapInArrow(lean(_signed(width, trees)), "doc_id long, n_shingles long, digest binary, sig binary, bits_1 long, bits_2 long"), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.keep(full.groupBy("digest").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("sig", "bits_1", "bits_2")), F.first("n_shingles").alias("n")), "classes")

    keys = F.array(*(F.struct(F.lit(t).alias("tree"), F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH).alias("key")) for t in range(trees)))
    forest = classes.select("node", F.col("n").cast("int").alias("n"), "bits_1", "bits_2", F.inline(keys))
    order = ["tree", "key", "node"]
    met = forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_forest_pairs(percent, trees)), "x long, y long, common long, near int, sparse int")
    met = scratch.keep(met.groupBy("x", "y").agg(F.sum(F.col("common") * F.col("near")).alias("common"), F.max("near").alias("near"), F.max("sparse").alias("sparse")), "met")
    pair = [F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")]
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("common"), "y"))
    first = scratch.keep(met.where("near = 1").withColumn("rank", rank).where(F.col("rank") <= BEST).select(*pair).distinct(), "first")
    sparse = met.where("sparse = 1").select(*pair).distinct()

    # regions that hold one class only are left out from here on
    region = F.xxhash64("tree", F.substring("key", 1, 4 * LEAST_DEPTH))
    every = classes.select("node", F.inline(keys)).select("node", F.col("tree").cast("byte").alias("tree"), region.alias("region"))
    shared = every.groupBy("region").agg(F.count("*").alias("members")).where("members > 1").select("region")
    regions = scratch.keep(every.join(shared, "region").select("node", "tree", "region"), "regions")

    # texts of classes that share a region with another one, or are candidates in a sparse one: only they are ever compared
    wanted = regions.select(F.col("node").alias("doc_id")).unionByName(sparse.select(F.explode(F.array("a", "b")).alias("doc_id"))).distinct()
    involved = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id"), "involved")

    # an id with several sets of shingles joins their classes
    several = full.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("doc_id")
    same = full.join(several, "doc_id").join(classes.select("digest", "node"), "digest").where("doc_id <> node")
    same = scratch.keep(same.select(F.greatest("doc_id", "node").alias("a"), F.least("doc_id", "node").alias("b")).distinct(), "same")
    links = _confirm(scratch, involved, first, width, percent).unionByName(same)
    found = scratch.keep(components(scratch, links), "components")

    tried = first
    for _ in range(PIVOTS):
        star = scratch.keep(_pivot_pairs(regions, classes, found, links, percent).join(tried, ["a", "b"], "left_anti"), "pivots")
        if star.isEmpty():
            break
        more = _confirm(scratch, involved, star, width, percent)
        links, found, tried = links.unionByName(more), merged(scratch, found, more), tried.unionByName(star)

    more = _confirm(scratch, involved, _across(sparse.join(tried, ["a", "b"], "left_anti"), found), width, percent)
    if not more.isEmpty():
        found = merged(scratch, found, more)

    late = scratch.keep(_open_links(scratch, regions, classes, found, involved, width, percent, trees), "late")
    if not late.isEmpty():
        found = merged(scratch, found, late)
    scratch.drop(involved, regions, met, first)

    named = classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    repeat = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("n_shingles"))
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0").withColumn("repeat", repeat)
    rows = known.unionByName(signed.where("doc_id IS NULL OR n_shingles = 0").withColumn("repeat", F.lit(1)))
    out = rows.join(named, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"), "repeat")
    kept = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("repeat") == 1))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def distinct_documents(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies, all columns: of each component of rows, the one with the smallest doc_id (a null
    id counts as the largest). Rows are nodes here, by a key written beside a copy of them: rows with a null doc_id and rows
    that share one are compared like any others, and rows without shingles are all kept."""
    scratch = Scratch(spark, "lsh-rows")
    key = "_row"
    rows = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(spark, rows.select(F.col(key).alias("doc_id"), "text"), width, percent)
    named = scratch.keep(found.select(F.col("doc_id").alias(key), "component_id"), "found")
    ids = rows.select(key, F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    first = named.join(ids, key).groupBy("component_id").agg(F.min(F.struct("none", "id", key)).alias("first"))
    return rows.join(first.select(F.col(f"first.{key}").alias(key)), key, "left_semi").select(*docs.columns)


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends lie in two components."""
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _in_components(regions: DataFrame, found: DataFrame) -> DataFrame:
    return regions.join(found, "node", "left").select("node", "tree", "region", F.coalesce("component", "node").alias("component")).distinct()


def _pivot_pairs(regions: DataFrame, classes: DataFrame, found: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Pairs (a > b) of each region's class with the most links and its classes of other components."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    rows = _in_components(regions, found).join(degree, "node", "left").join(classes.select("node", "n"), "node")
    best = rows.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("node")).alias("node"), "component", "n")).alias("best"))
    best = best.where("least < most AND best.degree > 0").select("region", (-F.col("best.node")).alias("pivot"), F.col("best.component").alias("its"), F.col("best.n").alias("m"))
    met = rows.join(best, "region").where(F.col("component") != F.col("its")).where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return met.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()


def _open_links(scratch: Scratch, regions: DataFrame, classes: DataFrame, found: DataFrame, involved: DataFrame, width: int, percent: int, trees: int) -> DataFrame:
    """Links (a > b) between classes of one region and two components. A first pass over signatures finds the classes of
    each block that have a partner whose signature and size allow the threshold; only those meet again with their texts, and
    their full sets are compared."""
    named = _in_components(regions, found)
    mixed = named.groupBy("region").agg(F.count("*").alias("members"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("region", "members")
    rows = named.join(mixed, "region").join(classes.select("node", "sig", "n"), "node")
    # blocks of a large region, each pair of blocks a group of its own
    n_blocks = F.ceil(F.col("members") / REGION).cast("int")
    rows = rows.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "component", "sig", "n", F.col("tree").cast("int").alias("tree"), "region", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    allowed = least_equal(trees * DEPTH, percent / 100)

    def compared(t: pa.Table):
        """Whole groups, which stand one after another: their links, or (without texts) the rows that may have one."""
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), ">u4").reshape(t.num_rows, -1).astype(np.uint32)
        node, comp, n, block, region, one, two = (t.column(c).to_numpy() for c in ("node", "component", "n", "block", "region", "one", "two"))
        last = np.concatenate(((region[1:] != region[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]), [True]))
        end = np.flatnonzero(last)[np.cumsum(last) - last] + 1
        tree = t.column("tree").to_numpy()
        a, b = [], []
        for i in np.flatnonzero(end - np.arange(len(end)) > 1):
            use = slice(i + 1, end[i])
            ok = (comp[use] != comp[i]) & (100 * np.minimum(n[use], n[i]) >= percent * np.maximum(n[use], n[i]))
            if one[i] != two[i]:
                ok &= block[use] != block[i]
            at = np.flatnonzero(ok) + i + 1
            if len(at):
                same = sig[at] == sig[i]
                first_tree = same.reshape(len(at), trees, DEPTH)[:, :, :LEAST_DEPTH].all(axis=2).argmax(axis=1)
                at = at[(same.sum(axis=1) >= allowed) & (first_tree == tree[i])]
                a.append(np.full(len(at), i))
                b.append(at)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        wanted, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        if "text" not in t.column_names:
            return t.select(["node", "region", "one", "two"]).take(pa.array(wanted)).to_batches()
        full = sets(t.column("text").take(pa.array(wanted)).combine_chunks(), width) if len(wanted) else []
        linked = np.zeros(len(a), bool)
        for k, (i, j) in enumerate(zip(place[: len(a)], place[len(a) :], strict=True)):
            s, r = full[i], full[j]
            both = int((r[np.minimum(np.searchsorted(r, s), len(r) - 1)] == s).sum())
            linked[k] = 100 * both >= percent * (len(s) + len(r) - both)
        a, b = node[a[linked]], node[b[linked]]
        return [pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            region, one, two = (batch.column(c).to_numpy() for c in ("region", "one", "two"))
            cut = np.flatnonzero((region != region[-1]) | (one != one[-1]) | (two != two[-1]))
            whole = int(cut[-1]) + 1 if len(cut) else 0
            if whole:
                yield from compared(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held = []
            held.append(batch.slice(whole))
            if len(held) > 1 and (held[0].column("region")[0], held[0].column("one")[0], held[0].column("two")[0]) != (held[1].column("region")[0], held[1].column("one")[0], held[1].column("two")[0]):
                yield from compared(pa.Table.from_batches(held[:-1]))
                held = held[-1:]
        if held:
            yield from compared(pa.Table.from_batches(held))

    keys = ["region", "one", "two"]
    meet = lambda df, out: df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), out)
    may = scratch.keep(meet(rows, "node long, region long, one int, two int").distinct(), "may")
    again = rows.join(may, ["node", *keys]).join(involved.withColumnRenamed("doc_id", "node"), "node")
    return meet(again, "a long, b long").where("a <> b").distinct()
