"""Replacing sources, cascades and tails of logs."""

import os

from loomline.operators import relational as R
from loomline.sources import logs

CATALOG = "id long, text string, source string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_replace_sources(spark):
    current = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", None)], CATALOG)
    incoming = spark.createDataFrame([(1, "A", "x"), (9, "N", None), (9, "N", None)], CATALOG)
    rows, removed = R.replace_sources(current, incoming, "source")
    assert rows_of(rows) == rows_of(spark.createDataFrame([(1, "A", "x"), (3, "c", "y"), (9, "N", None), (9, "N", None)], CATALOG))
    assert sorted(r["id"] for r in removed.collect()) == [1, 2, 4]
    again, _ = R.replace_sources(rows, incoming, "source")
    assert rows_of(again) == rows_of(rows)
    assert rows_of(R.replace_sources(current, current.limit(0), "source")[0]) == rows_of(current)


def test_cascade_and_set_null(spark):
    parents, children = spark.createDataFrame([(1,), (1,), (2,)], "p long"), spark.createDataFrame([(10, 1), (11, 3), (12, None)], "c long, p long")
    kept, removed = R.cascade(children, parents, "p")
    assert rows_of(kept) == [(10, 1), (12, None)] and rows_of(removed) == [(11, 3)]
    assert rows_of(R.set_null(children, parents, "p")) == [(10, 1), (11, None), (12, None)]


def test_write_sources_leaves_others_alone(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files = lambda s: sorted(os.listdir(tmp_path / "t" / f"source={s}"))
    R.write_sources(spark.createDataFrame([(1, "a", "x"), (3, "c", "y")], CATALOG), path, "source")
    before = files("y")
    R.write_sources(spark.createDataFrame([(2, "b", "x")], CATALOG), path, "source")
    assert files("y") == before and rows_of(spark.read.schema(CATALOG).parquet(path)) == [(2, "b", "x"), (3, "c", "y")]


def write(folder, name, lines, age, end="\n"):
    (folder / name).write_text("\n".join(lines) + end)
    os.utime(folder / name, (1_700_000_000 - age, 1_700_000_000 - age))


def test_tail_merges_newest_files_by_stamp(spark, tmp_path):
    write(tmp_path, "app.log", ["[2024-01-01 00:00:02] new b", "[2024-01-01 00:00:04] new d", "trace without stamp"], 0)
    write(tmp_path, "app_2024-01-01_00-00-00.log", ["[2024-01-01 00:00:01] old a", "[2024-01-01 00:00:02] old b"], 50, end="")
    write(tmp_path, "app.log.1", ["[2024-01-09 00:00:00] too old a file"], 900)
    write(tmp_path, "other.log", ["[2024-01-09 00:00:00] another log"], 0)
    path = f"file://{tmp_path}/app_2024-01-01_00-00-00.log"
    assert logs.name_pattern(path) == "app*.log*"
    lines = [r["line"] for r in logs.tail(spark, path, max_files=2).collect()]
    assert lines == ["trace without stamp", "[2024-01-01 00:00:01] old a", "[2024-01-01 00:00:02] new b", "[2024-01-01 00:00:02] old b", "[2024-01-01 00:00:04] new d"]
    assert [r["line"] for r in logs.tail(spark, path, max_files=2, max_lines=2).collect()] == ["[2024-01-01 00:00:02] old b", "[2024-01-01 00:00:04] new d"]


def test_tail_of_a_long_file_and_of_none(spark, tmp_path):
    text = [f"[2024-01-01 00:00:{i % 60:02d}] {i:04d} é" for i in range(500)]
    write(tmp_path, "long.log", text, 0)
    raw = (tmp_path / "long.log").read_bytes()[-2048:].decode(errors="replace").splitlines()[1:]
    got = logs.tail(spark, f"file://{tmp_path}/long.log", max_bytes=2048).collect()
    assert [r["line"] for r in sorted(got, key=lambda r: -r["nth"])] == raw
    assert logs.tail(spark, f"file://{tmp_path}/none.log").count() == 0
