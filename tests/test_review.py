"""The review queue, claims, references, evidence and points on made rows."""

import pytest
from pyspark.sql import functions as F

from loomline.plans import review_rules as V

DOCS = "doc_id long, path string, name string, status string, scope_label string, last_error string, status_id int, is_global boolean, entity_id long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a/x.PDF", "X", "needs_review", "Global", None, 2, True, None), (2, "b/y.ino", "Y", "failed", "Entity 7", None, 4, False, 7), (3, "z.md", None, "needs_review", None, "broke", 2, False, 8), (4, "/c//w.json", "W", "needs_review", "Entity 7", "", 2, True, 7), (5, "q", "Q", "indexed", "Global", None, 3, True, None), (6, " u ", "U", "needs_review", "x", None, 2, None, 7)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def listed(spark, docs):
    chunks = spark.createDataFrame([(1, 0.2), (1, 0.9), (2, 0.34), (3, 0.35), (5, 0.1), (None, 0.1)], "doc_id long, quality double")
    images = spark.createDataFrame([(1,), (1,), (3,)], "doc_id long")
    return lambda **kw: V.review_list(docs, chunks, images, **kw)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_scopes(listed):
    assert [ids(listed()), ids(listed(scope="global")), ids(listed(scope="entity", entity_id=7)), ids(listed(scope="entity")), ids(listed(scope="else"))] == [[1, 2, 3, 4, 6], [1, 4], [2], [], []]
    got = {r["doc_id"]: (r["chunk_count"], r["avg_quality"], r["low_quality_count"], r["image_count"]) for r in listed().collect()}
    assert got == {1: (2, 0.55, 1, 2), 2: (1, 0.34, 1, 0), 3: (1, 0.35, 0, 1), 4: (0, 0.0, 0, 0), 6: (0, 0.0, 0, 0)}


@pytest.mark.parametrize(
    "filters, want",
    [
        ({}, [1, 2, 3, 4, 6]),
        ({"search": " ENTITY 7 "}, [2, 4]),
        ({"search": "%"}, []),
        ({"search": "y b/y.ino"}, [2]),
        ({"kind": "pdf"}, [1]),
        ({"kind": "code"}, [2]),
        ({"kind": "text"}, [3]),
        ({"kind": "metadata"}, [4]),
        ({"kind": "other"}, [6]),
        ({"health": "failed"}, [2, 3]),
        ({"health": "no-chunks"}, [4, 6]),
        ({"health": "low-quality"}, [1, 2]),
        ({"health": "with-images"}, [1, 3]),
        ({"health": "without-images", "kind": "code"}, [2]),
        ({"folder": "c"}, [4]),
        ({"folder": "(root)"}, [3, 6]),
    ],
)
def test_triage(listed, filters, want):
    assert ids(V.triage(listed(), **filters)) == want


def test_claims(spark):
    rows = [(3, "queued", 5, None, "e", 1), (2, "queued", 5, None, "e", 2), (1, "running", 1, 9, "e", 3), (4, None, 0, None, "e", 4), (5, "queued", 6, None, "e", 5)]
    jobs = spark.createDataFrame(rows, "id long, status string, created_at long, worker int, last_error string, extra int")
    first = V.claim_next(jobs, 77)
    assert sorted((tuple(r) for r in first.collect()), key=lambda r: r[0]) == [(1, "running", 1, 9, "e", 3), (2, "running", 5, 77, None, 2), (3, "queued", 5, None, "e", 1), (4, None, 0, None, "e", 4), (5, "queued", 6, None, "e", 5)]
    third = V.claim_next(V.claim_next(first, 78), 79)
    assert {r["id"]: r["worker"] for r in third.collect()} == {1: 9, 2: 77, 3: 78, 4: None, 5: 79}
    assert V.claim_next(third, 80).where("worker = 80").count() == 0


def test_resolved(spark):
    docs = spark.createDataFrame([(1, "b", "n"), (2, "a", "n"), (3, "n", "m"), (4, None, "z"), (5, "a", "n"), (6, "c", None)], "doc_id long, path string, name string")
    got = V.resolved(spark.createDataFrame([("n", 1), ("m", 2), ("z", 3), (None, 4), ("b", 5), ("n", 1)], "ref string, k int"), docs)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == [("n", 1, "a", 2), ("n", 1, "a", 2), ("m", 2, "n", 3), ("z", 3, None, None), (None, 4, None, None), ("b", 5, "b", 1)]


def test_evidence(spark):
    chunks = spark.createDataFrame([(1, p, i, i % 2, float(i % 3)) for i, p in enumerate([1, 1, 1, 1, 2, 2, None])], "doc_id long, page int, chunk_index int, rank int, quality double")
    steps = spark.createDataFrame([("a", 1, 1), ("b", 1, None), ("c", 1, 9), ("d", 8, None), ("e", 1, None)], "id string, doc_id long, page int")
    got = {}
    for r in V.evidence(steps, chunks, 2).orderBy("id", "rank", F.desc("quality"), "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["chunk_index"])
    assert got == {"a": [2, 0], "b": [2, 4], "e": [2, 4]}


def test_points(spark):
    runs = [(i, i // 2, "ingest", "completed", None if i % 2 else "", "a\\b/" + "c" * 30 if i % 3 else "", 1, 0, 0) for i in range(40)]
    runs += [(100, 99, "index_check", "completed", "x", "", 1, 0, 0), (101, 99, "ingest", "failed", "x", "", 1, 0, 0), (102, 99, "ingest", "skipped", "x", "", 0, 0, 0), (103, 99, "", "skipped", "dir/", "", 0, 0, 2), (104, 100, None, "skipped", "no type", "", 1, 0, 0)]
    points = V.output_points(spark.createDataFrame(runs, "id int, started_at int, work_type string, status string, label string, source_path string, chunks int, images int, dropped int")).orderBy("place").collect()
    assert [r["id"] for r in points] == [*range(17, 40), 103]
    assert points[-1]["short_label"] == "dir" and points[0]["short_label"] == "c" * 23 + "..." and points[1]["label"] == "ingest"
