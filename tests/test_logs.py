"""State of a log with timers, over several runs on one checkpoint."""

import datetime

from pyspark.sql import functions as F

from veridock.streaming import logs

START = datetime.datetime(2024, 1, 1)
SCHEMA = "target long, event_id long, action string, at timestamp"


def at(seconds: float) -> datetime.datetime:
    return START + datetime.timedelta(seconds=seconds)


def test_expiry_over_runs(spark, tmp_path):
    def feed(rows):
        spark.createDataFrame([(t, i, a, None if s is None else at(s)) for t, i, a, s in rows], SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        changes = logs.run_to_end(logs.expiring_state(stream, 10_000, ("drop",), late="2 seconds"), str(tmp_path / "run"))
        return {r.target: (r.event_id, r.state) for r in logs.current(changes).collect()}, changes

    first, _ = feed([(1, 1, "a", 0), (1, 2, "b", 3), (1, 2, "b", 3), (2, 3, "a", 4), (2, 4, "drop", 5), (3, 6, "x", 6), (3, 5, "y", 6), (None, 7, "n", 7), (4, 8, None, 8), (5, 9, "z", None)])
    assert first == {1: (2, "b"), 2: (4, "INVALIDATED"), 3: (6, "x"), None: (7, "n"), 4: (8, None)}
    # the watermark is 15: what was last touched at 5 or before has been 10 s past it
    second, changes = feed([(2, 10, "late but in time", 6.5), (6, 11, "a", 17), (6, 12, "b", 16)])
    assert second == {1: (2, "EXPIRED"), 2: (10, "late but in time"), 3: (6, "x"), None: (7, "n"), 4: (8, None), 6: (11, "a")}
    # behind the watermark: not waited for; a target that was removed begins anew
    third, changes = feed([(3, 13, "too late", 14), (1, 14, "again", 18), (7, 15, "a", 30)])
    assert third == {1: (14, "EXPIRED"), 2: (10, "EXPIRED"), 3: (6, "EXPIRED"), None: (7, "EXPIRED"), 4: (8, "EXPIRED"), 6: (11, "EXPIRED"), 7: (15, "a")}
    assert changes.where("ended").groupBy("target", "event_id").count().where(F.col("count") > 1).count() == 0


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert logs.current(logs.run_to_end(logs.expiring_state(stream, 1000), str(tmp_path / "run"))).count() == 0


def test_batches_are_reduced(spark):
    rows = [(t, i, f"a{i}", at(i % 7)) for i in range(500) for t in (1, 2, None)]
    batches = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = batches.mapInArrow(logs._last_of_batches, SCHEMA).collect()
    assert {(r.target, r.event_id) for r in got} == {(1, 499 - 499 % 7 + 6 - 7), (2, 499 - 499 % 7 + 6 - 7), (None, 499 - 499 % 7 + 6 - 7)}
