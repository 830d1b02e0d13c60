"""Windows of sentences and lines against plain loops; sections, densities and sizes."""

import re

import pytest
from pyspark.sql import functions as F

from loomline.operators import sentences as S

COUNT = re.compile(r"\w+|[^\w\s]")


def spans(counts, size, overlap):
    """(first, past) of windows, by trying every start in turn."""
    out, start = [], 0
    while start < len(counts):
        past = max((e for e in range(start, len(counts) + 1) if sum(counts[start:e]) <= size), default=start)
        if past > start:
            out.append((start, past))
        start = next((e for e in range(start + 1, len(counts)) if sum(counts[start:e]) >= size - overlap), len(counts))
    return out


def windows_of(spark, texts, size, overlap):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r) for r in S.sentence_windows(docs, size, overlap, "doc_id").orderBy("doc_id", "window").collect()]


@pytest.mark.parametrize("size,overlap", [(12, 0), (12, 5), (7, 6), (40, 10)])
def test_windows_equal_plain_loops(spark, size, overlap):
    texts = [" ".join(f"S{i}x{j} " + "word " * ((i * 5 + j * j) % 11) + "end." for j in range(i)) for i in range(14)]
    got, want = windows_of(spark, texts, size, overlap), []
    for i, text in enumerate(texts):
        parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])|\n+", text) if p.strip()]
        for n, (a, z) in enumerate(spans([len(COUNT.findall(p)) for p in parts], size, overlap)):
            want.append((i, n, "Untitled Section", z - a, " ".join(parts[a:z])))
    assert got == want


def test_blocks_headings_and_long_sentences(spark):
    text = "Before it.\n\nFeatures\n\nOne two. Three four! five\nsix\n\n" + "long " * 30 + "\n\nDescription\n\nLast."
    assert windows_of(spark, [text, None, "", " \n\n "], 10, 2) == [
        (0, 0, "Untitled Section", 1, "Before it."),
        (0, 1, "Features", 3, "One two. Three four! five six"),  # cut before capitals and at line ends alone; the long block has no window
        (0, 2, "Description", 1, "Last."),
    ]


def test_overlap_must_be_smaller(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        S.sentence_windows(docs, 10, 10, "doc_id")
    with pytest.raises(ValueError):
        S.adaptive_windows(docs, 10, 7, "doc_id")


def test_math_lines_come_again_in_overlaps(spark):
    text = "# A\nx = 1\n\n y = x + 2 \n# B\nplain words here"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = [tuple(r)[1:] for r in S.math_lines(docs, "doc_id", size=8, overlap=6).orderBy("window").collect()]
    by_window = {}
    for w, section, line in got:
        by_window.setdefault(w, []).append((section, line))
    assert by_window[0] == [("Math Section", "# A"), ("Variable Definition", "x = 1")]  # 2 and 3 tokens; 5 more would be too many
    assert by_window[1] == [("Variable Definition", "x = 1"), ("Variable Definition", "y = x + 2")]
    assert by_window[2] == [("Variable Definition", "y = x + 2")] and [x for _, x in by_window[3]] == ["# B", "plain words here"]


def test_sections_and_sizes(spark):
    texts = ["Intro one\nbody a\nbody b\n##\nmore\nLast line", "no title\nhere", None, "", "Only one line"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", S.sections(F.col("text")).alias("s"), S.adaptive_size(F.col("text"), 100).alias("n")).orderBy("i").collect()
    assert [tuple(x) for x in rows[0]["s"]] == [("Intro one", "body a\nbody b"), ("##", "more\nLast line")]
    assert [tuple(x) for x in rows[1]["s"]] == [("Full Document", texts[1])] and [tuple(x) for x in rows[4]["s"]] == [("Full Document", texts[4])]
    assert rows[0]["n"] == 150 and rows[3]["n"] == 150
    dense = spark.createDataFrame([("." * 20,), ("." * 50,), ("." * 9,)], "text string").select(S.adaptive_size(F.col("text"), 100)).collect()
    assert [r[0] for r in dense] == [100, 75, 150]
