"""Work items over a stream of events, with state for each worker: a start that nothing follows in time is abandoned.

The rule doesn't depend on how rows fall into micro-batches: gaps between rows that are there are judged at once, in order of
time; the last open start of a worker waits for an event-time timer. Rows behind the watermark are dropped by Spark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times are microseconds since the epoch, so that no time zone comes in between.
OUT = "user_id long, started long, ended long, state string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster names one for checkpoints; a temporary one only where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="spark-stream-")
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def tracker(start: str, finish: str, seconds: int):
    """A processor of rows (user_id, us, event_type): each start ends finished, replaced by another start, or abandoned after so
    many seconds without either. The class is made here, so that it is pickled by value and workers need not import this package."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    span, names = seconds * 1_000_000, ["user_id", "started", "ended", "state"]

    def closed(user, since, now, event):
        if now is None or now > since + span:
            return user, since, since + span, "abandoned"
        return user, since, now, "finished" if event == finish else "replaced"

    class Tracker(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.open = handle.getValueState("open", "us long")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            frame = pd.concat(list(rows)).sort_values(["us", "event_type"])
            since, out = self.open.get()[0] if self.open.exists() else None, []
            for us, event in zip(frame["us"].tolist(), frame["event_type"], strict=True):
                if event in (start, finish):
                    out += [closed(key[0], since, us, event)] if since is not None else []
                    since = us if event == start else None
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if since is None:
                self.open.clear()
            else:
                self.open.update((since,))
                self.handle.registerTimer((since + span) // 1000 + 1)
            yield pd.DataFrame(out, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            out = [closed(key[0], self.open.get()[0], None, None)] if self.open.exists() else []
            self.open.clear()
            yield pd.DataFrame(out, columns=names)

        def close(self):
            pass

    return Tracker()


def work_states(events: DataFrame, start: str, finish: str, seconds: int, lateness: str) -> DataFrame:
    """(user_id, started, ended, state) of a stream of events (user_id, ts, event_type)."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_type").withColumn("us", F.unix_micros("at")).withWatermark("at", lateness)
    return rows.groupBy("user_id").transformWithStateInPandas(tracker(start, finish, seconds), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def upsert_into(path: str):
    """For foreachBatch: what a batch says of its keys, in a folder of its own, so that a batch that runs again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def latest(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """The table that batches were upserted into: of each key, what its last batch said."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def run_to_end(stream: DataFrame, path: str) -> None:
    """Process all that is there, upserting into path, and stop. State with timers needs the RocksDB store, for this query alone."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    had = conf.get(name, None)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.foreachBatch(upsert_into(f"{path}/table")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.unset(name) if had is None else conf.set(name, had)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream. A path with a pattern may lead to one file as well as to a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
