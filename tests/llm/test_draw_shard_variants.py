"""Importance resampling, sharding and spelling variants against plain loops, and odd inputs."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm import importance_resampling, queries, shard_lpt, spelling_variants
from loomline.llm.position_crc import crc32_spans
from loomline.llm.ranges import numbered
from loomline.llm.shared import Scratch, ship_package

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score double, n long, _row int, shard int, slot int, rank int, word string, _group long"
ODD = [(1, None), (2, ""), (3, "One two"), (3, "One two"), (None, "Wonderful wonderfull"), (None, None), (4, "wonderful " * 30 + "wonderfal"), (5, "x" * 70_000), (6, "x" * 69_999), (7, "Ünïçödé ünïçödé été 日本語日本語日本語日本語 \x00 a1b2"), (8, "\n\t \n"), (9, "x" * 70_000), (10, "z" * 200 + " " + "z" * 201)]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0.5, 1, 1, 2, 3, 4, "w", 5) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=str)


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=700), st.lists(st.tuples(st.integers(0, 700), st.integers(0, 700)), max_size=20))
def test_checksums_of_spans(data, cuts):
    cuts = [(min(a, b, len(data)), min(max(a, b), len(data))) for a, b in cuts]
    got = crc32_spans(np.frombuffer(data, np.uint8), np.array([a for a, _ in cuts], np.int64), np.array([b for _, b in cuts], np.int64))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in cuts]


def test_checksums_of_long_spans():
    data = np.random.default_rng(1).integers(0, 256, 3_000_000).astype(np.uint8)
    spans = [(0, 3_000_000), (5, 1_500_000), (7, 7 + 64), (7, 7 + 65), (7, 7 + 128), (9, 9), (1, 1 + 64 * 1024), (0, 1)]
    got = crc32_spans(data, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in spans]


def words_of(text, longest=1):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled(documents, target, percent, longest=1, buckets=10000, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in documents for f in words_of(t, longest)[1])
    t = Counter(bucket(f) for _, x in target for f in words_of(x, longest)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in s}
    out = []
    for i, text in documents:
        words, made = words_of(text, longest)
        weight = sum(gain[bucket(f)] for f in made) // len(made) if made else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(made), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for r in out:
        r.append(None)
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(((*r[:4], r[5]) for r in out), key=str)


@pytest.mark.parametrize(("percent", "longest", "buckets"), [(10, 1, 10000), (37, 3, 97), (100, 2, 10000), (0, 1, 10000)])
def test_resampling(spark, docs, percent, longest, buckets):
    target = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = importance_resampling.resample(spark, docs.repartition(5), target, percent, longest, buckets)
    want = resampled(rows_of(docs), [(0, r.text) for r in target.select("text").collect()], percent, longest, buckets)
    assert rows(got, "doc_id", "n_features", "weight", "score", "rank") == want


def test_resampling_query_and_odd_input(spark, odd, none):
    assert rows(queries.op11_importance_resampling(spark, DATA)) == resampled(rows_of(spark.read.parquet(f"{DATA}/documents.parquet")), rows_of(spark.read.parquet(f"{DATA}/benchmark.parquet").withColumn("doc_id", F.lit(0))), 10)
    for target in (odd, none):
        got = importance_resampling.resample(spark, odd, target, 100)
        assert rows(got, "doc_id", "n_features", "weight", "score", "rank") == resampled(rows_of(odd), rows_of(target), 100)
    assert importance_resampling.resample(spark, none, odd).count() == 0


def test_ranks_of_ties_and_repeated_rows(spark):
    one = spark.createDataFrame([(i % 3, "same words here " * 7) for i in range(60)], "doc_id long, text string").repartition(7)
    got = importance_resampling.resample(spark, one, one, 50)
    assert sorted(r.rank for r in got.where("rank IS NOT NULL").collect()) == list(range(1, 31))
    assert rows(got, "doc_id", "n_features", "weight", "score", "rank") == resampled(rows_of(one), rows_of(one), 50)


def test_numbers_follow_the_order(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 501).alias("a"), "id").repartition(9)
    got = numbered(Scratch(spark, "t"), frame, [F.col("a").desc(), F.col("id")], "n").collect()
    assert [r.number for r in sorted(got, key=lambda r: (-r.a, r.id))] == list(range(5000))


def test_schedule():
    sizes = np.random.default_rng(3).integers(1, 1000, 500).tolist()
    got = shard_lpt.schedule(sizes, 7)
    loads, want = [0] * 7, [0] * 500
    for i in sorted(range(500), key=lambda i: (-sizes[i], i)):
        want[i] = min(range(7), key=lambda s: (loads[s], s))
        loads[want[i]] += sizes[i]
    assert got == want
    last = {s: min(x for x, t in zip(sizes, got, strict=True) if t == s) for s in range(7)}
    assert all(loads[s] - last[s] <= min(loads) for s in range(7))  # the last unit of a shard found it least loaded


def dealt(documents, shards):
    """Longest first over groups of equal texts, or bundles of small ones."""
    size = lambda t: len((t or "").encode()) + 16
    total, groups = sum(size(t) for _, t in documents), defaultdict(list)
    for i, t in documents:
        groups[t or ""].append(i)
    units = defaultdict(lambda: [0, [], []])
    for t, ids in groups.items():
        whole = len(ids) * size(t)
        unit = units[("w", t) if whole * shard_lpt.UNITS * shards >= total else ("b", zlib.crc32(t.encode()) % (shard_lpt.BUNDLES * shards))]
        unit[0] += whole
        unit[1] += ids
        unit[2].append(t)
    heap, shard_of = [(0, s) for s in range(shards)], {}
    for whole, _, texts in sorted(units.values(), key=lambda u: (-u[0], min((i is not None, i or 0) if None not in u[1] or any(j is not None for j in u[1]) else (False, 0) for i in u[1] if i is not None or all(j is None for j in u[1])))):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + whole, s))
        shard_of.update(dict.fromkeys(texts, s))
    return [(i, size(t), zlib.crc32((t or "").encode()), shard_of[t or ""]) for i, t in documents]


def test_sharding(spark, docs, odd, none):
    got = queries.op12_lpt_sharding(spark, DATA).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == sorted(dealt(rows_of(docs), 40))
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append((r.slot, r.doc_id))
        assert (r.law, r.grown_shard) == ("bytes", None)
    for found in by_shard.values():
        assert [s for s, _ in sorted(found)] == list(range(len(found)))
        assert [i for _, i in sorted(found)] == sorted(i for _, i in found)
    for shards in (1, 3):
        got = shard_lpt.assign(spark, odd, shards).collect()
        assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got), key=str) == sorted(dealt(ODD, shards), key=str)
        assert sorted(r.slot for r in got if r.shard == 0) == list(range(sum(r.shard == 0 for r in got)))
    assert shard_lpt.assign(spark, none, 4).count() == 0


def test_groups_stay_together_and_loads_are_even(spark, monkeypatch):
    """With small bounds on units, most groups share bundles; equal texts still stay together."""
    monkeypatch.setattr(shard_lpt, "UNITS", 3)
    monkeypatch.setattr(shard_lpt, "BUNDLES", 32)
    documents = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.pmod(F.xxhash64("id"), F.lit(3000)).cast("string"), F.when(F.col("id") % 9 == 0, F.repeat(F.lit("x"), 400)).otherwise("")).alias("text"))
    got = shard_lpt.assign(spark, documents, 8)
    assert got.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").isEmpty()
    loads = [r.b for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 8 and max(loads) <= 1.05 * min(loads)


def test_shards_are_written_in_slot_order(spark, docs, tmp_path):
    shard_lpt.write(spark, docs, 5, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert rows(back, "doc_id", "text") == rows(docs, "doc_id", "text")
    assert back.groupBy("shard").agg(F.count("slot").alias("n"), F.max("slot").alias("m")).where("m <> n - 1").isEmpty()


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def variants(documents):
    counts = Counter()
    for i, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    around = defaultdict(set)
    for w in n:  # words one edit apart share a form that lacks one letter, or one of them is that form of the other
        for lack in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} if len(w) < 1000 else {w, w[1:]}:
            around[lack].add(w)
    near = {w: set() for w in n}
    for group in around.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def test_variants_query(spark, docs):
    got = rows(queries.op13_spelling_variants(spark, DATA), "word", "form", "root", "n", "n_near", "form_n")
    assert got == variants(rows_of(docs))
    assert sum(r[4] > 0 for r in got) > 50


def test_variants_of_odd_input(spark, odd, none):
    both = odd.union(odd).union(odd)
    names = ("word", "form", "root", "n", "n_near", "form_n")
    assert rows(spelling_variants.variants(spark, both), *names) == variants(rows_of(both))
    assert spelling_variants.variants(spark, none).count() == 0


def test_chains_lead_to_their_root(spark):
    text = [(1, "aaaaaaab " * 2000 + "aaaaaabb " * 200 + "aaaaabbb " * 20 + "aaaabbbb " * 2), (1, "éaaaaaaab " * 20 + "aaaaaaaab " * 3)]
    frame = spark.createDataFrame(text, "doc_id long, text string")
    got = rows(spelling_variants.variants(spark, frame), "word", "form", "root", "n", "n_near", "form_n")
    assert got == variants(text)
    assert max(len({r[0] for r in got if r[2] == root}) for root in {r[2] for r in got}) >= 4


@pytest.mark.parametrize("tile", [2, 5, 128])
def test_tiles_find_each_near_pair_once(spark, monkeypatch, tile):
    """Dense sets of words: every string of few letters, and long words; blocks of any size, and buckets over many blocks."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(7, 10))) for _ in range(700)} | {"q" * n for n in range(7, 60)} | {"q" * n + "r" + "q" * (50 - n) for n in range(50)}
    counted = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    found = []
    monkeypatch.setattr(spelling_variants, "TILE", tile)
    table = spelling_variants.buckets(counted).orderBy("longer", "bucket").toArrow()
    i, j = spelling_variants.tiles(table)
    column = table.column("word").to_pylist()
    found = [tuple(sorted((column[a], column[b]))) for a, b in zip(i, j, strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert spelling_variants.neighbours(counted).count() == 2 * len(found)
