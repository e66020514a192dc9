"""The event log as a stream that runs to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridock.plans.registry import query
from veridock.session import scratch, table
from veridock.streaming import logs

HOUR_MS = 3_600_000
#: A user's state expires so many hours after the last event; errors invalidate it.
TTL_HOURS = 24


@query(f"""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
 l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) = 1)
 SELECT user_id, event_id, CASE WHEN us // 1000 + {TTL_HOURS * HOUR_MS} <= (SELECT max(us) // 1000 FROM e) THEN 'EXPIRED' WHEN event_type = 'error' THEN 'INVALIDATED' ELSE event_type END AS state FROM l""")
def expiring_actions(spark, sf_dir):
    """The state of each user after the whole log, kept by a stream with state and timers: R13 K2 U6."""
    source = table(spark, sf_dir, "events")
    events = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    rows = events.select(F.col("user_id").cast("long").alias("target"), F.col("event_id").cast("long").alias("event_id"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("at"))
    changes = logs.run_to_end(logs.expiring_state(rows, TTL_HOURS * HOUR_MS, ("error",)), scratch(spark))
    return logs.current(changes).select(F.col("target").alias("user_id"), "event_id", "state")
