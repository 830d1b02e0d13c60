"""State and timers of a stream over several runs."""

import datetime

from pyspark.sql import functions as F

from loomline.streaming import work as W

START = datetime.datetime(2024, 5, 1)


def test_runs_with_late_rows(spark, tmp_path):
    events, path = f"file://{tmp_path}/events", f"file://{tmp_path}/out"
    add = lambda *rows: spark.createDataFrame([(u, START + datetime.timedelta(minutes=m), e) for u, m, e in rows], "user_id long, ts timestamp_ntz, event_type string").coalesce(1).write.mode("append").parquet(events)

    def run():
        W.run_to_end(W.work_states(W.stream_of(spark, events), "start", "done", 1800, "10 minutes"), path)
        rows = W.latest(spark, f"{path}/table", ["user_id", "started"], W.OUT)
        zero = F.unix_micros(F.lit(START).cast("timestamp"))
        return sorted(tuple(r) for r in rows.select("user_id", *((F.col(c) - zero).alias(c) for c in ("started", "ended")), "state").selectExpr("user_id", "started div 60000000 AS a", "ended div 60000000 AS b", "state").collect())

    add((1, 0, "start"), (1, 20, "done"), (1, 25, "start"), (2, 0, "start"), (2, 10, "start"), (3, 5, "other"), (4, 45, "start"))
    first = [(1, 0, 20, "finished"), (2, 0, 10, "replaced")]
    assert run() == first  # the watermark is at minute 35: no open start is 30 minutes old by then
    add((1, 40, "done"), (2, 12, "done"), (5, 120, "other"))  # user 2's row is behind the watermark
    second = [*first[:1], (1, 25, 40, "finished"), first[1], (2, 10, 40, "abandoned"), (4, 45, 75, "abandoned")]
    assert run() == second
    assert run() == second
    add((4, 200, "start"), (4, 231, "done"))
    assert run() == [*second, (4, 200, 230, "abandoned")]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    put, frame = W.upsert_into(path), lambda *rows: spark.createDataFrame(rows, "k long, v string")
    put(frame((1, "a"), (2, "b")), 0)
    put(frame((2, "c")), 1)
    put(frame((2, "c"), (3, "d")), 1)
    assert sorted(tuple(r) for r in W.latest(spark, path, ["k"], "k long, v string").collect()) == [(1, "a"), (2, "c"), (3, "d")]
