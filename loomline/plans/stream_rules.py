"""Queries that run a stream to its end; their SQL tells the same from the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.plans.registry import query
from loomline.streaming import work as W


@query("""WITH e AS (SELECT user_id, ts, event_type, lead(ts) OVER w AS nxt, lead(event_type) OVER w AS what FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
s AS (SELECT *, nxt IS NULL OR nxt > ts + INTERVAL 6 HOUR AS late FROM e WHERE event_type = 'click' AND (nxt IS NOT NULL OR epoch_ms(ts) + 21600001 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)))
SELECT user_id, ts AS started, CASE WHEN late THEN ts + INTERVAL 6 HOUR ELSE nxt END AS ended, CASE WHEN late THEN 'abandoned' WHEN what = 'purchase' THEN 'finished' ELSE 'replaced' END AS state FROM s""")
def abandoned_work(spark, sf_dir):
    """Work of each user from a click to a purchase or another click, abandoned after 6 hours; open work that the watermark
    (an hour behind the last event) hasn't reached yet has no row."""
    path = W.shared_folder(spark, "work")
    W.run_to_end(W.work_states(W.stream_of(spark, f"{sf_dir}/events.parquet"), "click", "purchase", 6 * 3600, "1 hour"), path)
    rows = W.latest(spark, f"{path}/table", ["user_id", "started"], W.OUT)
    return rows.select("user_id", *(F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")), "state")
