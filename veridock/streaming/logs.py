"""The append-only logs as streams: event counts in windows, the latest state of each target, and that state with expiry and
invalidation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veridock.operators import rules


def log_stream(spark: SparkSession, folder: str, schema: str, time_col: str = "timestamp") -> DataFrame:
    """New files of a folder of JSON lines as they come."""
    return spark.readStream.schema(schema).json(folder).withColumn(time_col, F.to_timestamp(time_col))


def event_counts(events: DataFrame, time_col: str = "timestamp", by: str = "event", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by event and window; events later than the watermark are not waited for."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def latest_state(events: DataFrame, time_col: str = "timestamp", by: tuple[str, ...] = ("run_id", "target_id")) -> DataFrame:
    """The last action on each target, kept up to date (update or complete mode)."""
    return events.groupBy(*by).agg(F.max_by("action", time_col).alias("action"), F.max(time_col).alias("at"))


#: What ``expiring_state`` calls a target that an action has invalidated, or that nothing has touched for too long.
INVALIDATED, EXPIRED = "INVALIDATED", "EXPIRED"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _last_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last event of each target in each Arrow batch: what a stream shuffles of a target that many events have."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by([("at", "ascending"), ("event_id", "ascending")])
        last = rows.group_by("target", use_threads=False).aggregate([(c, "last") for c in ("event_id", "action", "at")])
        named = last.rename_columns([c.removesuffix("_last") for c in last.column_names]).select(batch.schema.names)
        yield from named.cast(batch.schema).combine_chunks().to_batches()


class _Latest(StatefulProcessor):
    """The last event of a target, with a timer that ends it."""

    def __init__(self, ttl_ms: int, invalidating: tuple[str, ...]):
        self.ttl_ms, self.invalidating = ttl_ms, invalidating

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id bigint, action string, at_ms bigint, at_us bigint")

    def _row(self, key, event_id: int, state: str | None, at_us: int) -> pd.DataFrame:
        return pd.DataFrame({"target": pd.array([key[0]], dtype="Int64"), "event_id": [event_id], "state": [state], "at_us": [at_us], "ended": [state == EXPIRED]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        best = None if before is None else (before[3], before[0], before[1])
        for frame in rows:
            for event_id, action, at_us in zip(frame["event_id"], frame["action"], frame["at_us"], strict=True):
                event = (int(at_us), int(event_id), None if pd.isna(action) else action)
                best = event if best is None or event[:2] > best[:2] else best
        if before is not None:
            if best[:2] == (before[3], before[0]):
                return
            self.handle.deleteTimer(before[2] + self.ttl_ms)
        at_us, event_id, action = best
        self.last.update((event_id, action, at_us // 1000, at_us))
        self.handle.registerTimer(at_us // 1000 + self.ttl_ms)
        yield self._row(key, event_id, INVALIDATED if action in self.invalidating else action, at_us)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        event_id, _, _, at_us = self.last.get()
        self.last.clear()
        yield self._row(key, event_id, EXPIRED, at_us)

    def close(self) -> None:
        pass


def expiring_state(events: DataFrame, ttl_ms: int, invalidating: tuple[str, ...] = (), late: str = "0 seconds") -> DataFrame:
    """Changes of each target's state: target, event_id, state, at_us, ended.

    ``events`` (a stream): target (bigint), event_id (bigint), action, at (timestamp). The state is the last action (by time,
    then id; null stays null), ``INVALIDATED`` if that is an invalidating one, and ``EXPIRED`` once the watermark, the
    latest time seen less ``late``, is ``ttl_ms`` past it. Then the target's state is removed, so that what is kept does not
    grow with all targets ever seen. Events behind the watermark are not waited for; those without a time have no place and go;
    a null target is a target. Repeated events change nothing. Each Arrow batch is reduced to its last events before the
    shuffle, so a target of very many events brings few rows. Needs the RocksDB state store (``run_to_end`` sets it)."""
    rows = events.where("at is not null and event_id is not null").select("target", "event_id", "action", "at")
    last = rows.mapInArrow(_last_of_batches, rows.schema).withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    return last.groupBy("target").transformWithStateInPandas(_Latest(ttl_ms, tuple(invalidating)), "target bigint, event_id bigint, state string, at_us bigint, ended boolean", "Append", "EventTime")


def current(changes: DataFrame) -> DataFrame:
    """The last change of each target."""
    return rules.latest(changes, ["target"], ["at_us", "event_id", "ended"])


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all there is, from where the last run ended, and read what it has written so far. ``folder`` is one that
    driver and executors share; a lost executor's work is done again from the checkpoint in it."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
