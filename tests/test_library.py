"""Every query against its SQL on the smallest tables, and rules against plain restatements."""

import datetime
import decimal
import glob
import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomline.functions import columns as C
from loomline.operators import chunks as K
from loomline.operators import relational as R
from loomline.operators import windows as W
from loomline.plans import registry
from loomline.sources.tables import lines, table
from loomline.streaming.telemetry import stream_buckets

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, list):
        return [norm(x) for x in v]
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(registry.ORACLE_SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = sorted(str([norm(r[names.index(c)]) for c in cols]) for r in rel.fetchall())
    assert sorted(str([norm(r[c]) for c in cols]) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_allocation_is_exact(spark):
    rows = spark.createDataFrame([(1, i, Decimal("10.00000000"), w) for i, w in enumerate([Decimal(1), Decimal(1), Decimal(1)])] + [(2, 0, Decimal("7.12345678"), Decimal(0)), (2, 1, Decimal("7.12345678"), Decimal(0))], "b int, i int, t decimal(14,8), w decimal(14,8)")
    out = W.allocate(rows, ["b"], "i", "t", "w").groupBy("b").agg(F.sum("allocated").alias("s")).collect()
    assert {r.b: r.s for r in out} == {1: Decimal("10"), 2: Decimal("7.12345678")}


def test_budget_keeps_first(spark):
    rows = spark.createDataFrame([("a", 1, 900), ("a", 2, 10), ("b", 1, 5), ("b", 2, 5), ("b", 3, 5)], "g string, i int, n int")
    assert sorted((r.g, r.i) for r in W.within_budget(rows, ["g"], [F.asc("i")], "n", 10).collect()) == [("a", 1), ("b", 1), ("b", 2)]


def test_upsert_keeps_old_where_new_is_null(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(tuple(r) for r in R.upsert(old, new, "k").collect()) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]


def test_inserts_once(spark):
    rows = lambda r: spark.createDataFrame(r, "k int, v string")
    got = R.insert_new(rows([(1, "a")]), rows([(1, "b"), (2, "d"), (2, "c"), (None, "x"), (None, "y")]), "k").collect()
    assert sorted((r.k or 0, r.v) for r in got) == [(0, "x"), (0, "y"), (1, "a"), (2, "c")]


def test_search_without_the_question(spark, tmp_path):
    spark.read.parquet(f"{DATA}/embeddings.parquet").limit(0).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    table(spark, DATA, "documents").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert [registry.QUERIES[q](spark, f"file://{tmp_path}").count() for q in ("vector_search_topk", "multi_query_fusion")] == [0, 0]


def test_diff(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k int, m int"), spark.createDataFrame([(2, 5), (3, None), (4, 4)], "k int, m int")
    assert {r.k: r.change for r in R.snapshot_diff(a, b, "k", "m").collect()} == {1: "removed", 2: "modified", 3: "unchanged", 4: "added"}


def test_null_entity_sees_global_rows_only(spark):
    rows = spark.createDataFrame([(True, 1), (False, 2), (None, 3)], "is_global boolean, entity_id int")
    assert rows.where(C.visible_to(None)).count() == 1 and rows.where(C.visible_to(2)).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(f"file://{tmp_path}/events")
    q = stream_buckets(spark, f"file://{tmp_path}/events", 3600).writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.bucket, r.peak, r.n) for r in spark.table("buckets").collect()}
    assert got == {(r.b.replace(tzinfo=None), r.peak, r.n) for r in events.groupBy(R.bucket("ts", 3600).alias("b")).agg(F.max("value").alias("peak"), F.count("*").alias("n")).collect()}


def test_chunks_equal_a_plain_loop(spark):
    blocks = K.blocks(lines(table(spark, DATA, "documents"))).select("doc_id", "block", "tokens").collect()
    by, want = {}, set()
    for r in blocks:
        by.setdefault(r.doc_id, []).append((r.block, r.tokens))
    for doc, found in by.items():
        made = []
        for block, tokens in sorted(found):
            if made and made[-1][1] + tokens <= 420:
                made[-1][1] += tokens
            else:
                made.append([block, tokens])
        want |= {(doc, i, b, t) for i, (b, t) in enumerate(made)}
    got = registry.QUERIES["chunk_documents"](spark, DATA).collect()
    assert {(r.doc_id, r.chunk, r.first_block, r.tokens) for r in got} == want and len(got) == len(want)


def test_large_blocks_stay_whole(spark):
    rows = spark.createDataFrame([(1, 1, 500), (1, 2, 10), (1, 4, 410), (1, 6, 1), (2, 3, 0)], "doc_id int, block long, tokens long")
    assert sorted(tuple(r) for r in K.merge_blocks(rows, 420).collect()) == [(1, 0, 1, 500), (1, 1, 2, 420), (1, 2, 6, 1), (2, 0, 3, 0)]


def test_upsert_rules_with_nulls_and_empty_values(spark):
    kind = "k int, a string, b string, c string, d string, e int, f int"
    old = spark.createDataFrame([(1, "a", "b", "c", "d", 5, 1), (2, "a", "b", "c", None, None, 2)], kind)
    new = spark.createDataFrame([(1, None, None, "", "x", 3), (2, "y", "y", "y", "y", 4), (3, "z", "z", "z", "z", 6)], "k int, a string, b string, c string, d string, e int")
    rules = {"a": "overwrite", "b": "keep_if_null", "c": "keep_if_empty", "d": "existing", "e": "greatest"}
    assert sorted(tuple(r) for r in R.merge_rows(old, new, "k", rules).collect()) == [(1, None, "b", "c", "d", 5, 1), (2, "y", "y", "y", "y", 4, 2), (3, "z", "z", "z", "z", 6, None)]


def plain_chunks(codes, kinds, tokens, budget, overlap):
    """The rule of chunks, line by line, over lists of line numbers."""
    blocks, section, ended = [], -1, True
    for i, code in enumerate(codes):
        if code:
            section, ended = i if code == 2 else section, True
        elif ended or (kinds[i] >= 0 and kinds[i] != kinds[blocks[-1][1][0]]):
            blocks.append((section, [i]))
            ended = False
        else:
            blocks[-1][1].append(i)
    total, out, held = lambda lines: sum(tokens[i] for i in lines if i >= 0), [], None
    for section, lines in [*blocks, (None, None)]:
        small = lines is not None and kinds[lines[0]] < 0 and total(lines) < budget
        if small and (held is None or (held[0] == section and total(held[1] + lines) <= budget)):
            held = (section, held[1] + [-1] + lines if held else lines)
            continue
        if held:
            out.append((held[0], held[1][0], held[1]))
        held, at = None, 0
        while lines and at < len(lines):
            end = next((e for e in range(len(lines), at + 1, -1) if total(lines[at:e]) <= budget), at + 1)
            out.append((section, lines[0], lines[at:end]))
            back = next((k for k in range(end - 1, at, -1) if total(lines[k:end]) >= overlap), at) if overlap else end
            at = len(lines) if end == len(lines) else max(at + 1, back)
    return out


def test_chunk_bounds_equal_a_plain_loop():
    from loomline.plans.line_rules import chunk_bounds

    rng = np.random.default_rng(11)
    for case in range(400):
        n = int(rng.integers(0, 40))
        codes, kinds, tokens = rng.choice([0, 0, 0, 0, 1, 2], n), rng.choice([-1, -1, -1, 0, 1], n), rng.integers(1, 12, n)
        budget, overlap = int(rng.integers(1, 40)), int(rng.integers(0, 12))
        got = chunk_bounds(budget, overlap)(codes, kinds, tokens)
        assert [(a, b, list(c)) for a, b, c in got] == plain_chunks(codes.tolist(), kinds.tolist(), tokens.tolist(), budget, overlap), case


def test_chunks_keep_sections_and_kinds_apart(spark):
    from loomline.plans.line_rules import chunks

    text = "\n\n".join(["Overview", "a b c", "- d e", "Table: 12 34 max", "Notes", "f\n" + "g " * 9 + "\n" + "h " * 9, "i j\r\n\r\n\r\nk"])
    docs = spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "Notes")], "doc_id long, text string")
    got = [(r.doc_id, r.chunk, r.section, r.kind, r.text, r.n_tokens) for r in chunks(docs, 12, 0).orderBy("doc_id", "chunk").collect()]
    assert got == [(1, 0, "Overview", "paragraph", "a b c\n\n- d e", 6), (1, 1, "Overview", "table", "Table: 12 34 max", 5), (1, 2, "Notes", "paragraph", "f\n" + " ".join("g" * 9), 10), (1, 3, "Notes", "paragraph", " ".join("h" * 9), 9), (1, 4, "Notes", "paragraph", "i j\n\nk", 3)]


def test_document_chunks_hold_every_kept_line(spark):
    from loomline.functions import lines as L

    docs = table(spark, DATA, "documents")
    lines_of = {r.doc_id: r.l for r in docs.select("doc_id", F.filter(F.split(L.normalized(F.col("text")), "\n"), lambda x: (x != "") & ~L.classified(x).heading).alias("l")).collect()}
    got = {}
    for r in registry.QUERIES["document_chunks"](spark, DATA).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, set()).update(r.text.split("\n"))
    assert all(set(v) <= got.get(k, set()) for k, v in lines_of.items() if v)


def test_sample_by_share_keeps_the_same_rows_anywhere(spark):
    rows = [(i, "large", 10) for i in range(3000)] + [(i, "small", 10) for i in range(3000, 3500)] + [(9000, None, 0), (None, "large", 0), (None, "small", 0)]
    frame = spark.createDataFrame(rows, "id long, source string, n long")
    got = [{(r.id, r.source, r.rate, r.kept) for r in R.kept_by_share(frame.repartition(k), "id", "source", "n").collect()} for k in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert {(s, rate) for _, s, rate, _ in got[0]} == {("large", 0.75), ("small", 1.0), (None, 1.0)}
    assert abs(sum(k for _, s, _, k in got[0] if s == "large") - 2250) < 100 and all(k for _, s, _, k in got[0] if s != "large")
    assert (None, "large", 0.75, False) in got[0]
    assert R.kept_by_share(frame.where("id < 0"), "id", "source", "n").count() == 0
