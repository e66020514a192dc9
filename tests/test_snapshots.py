"""Snapshots in buckets against a fold of all changes."""

import pathlib
import random

from pyspark.sql import functions as F

from veridock.session import scratch
from veridock.sources.snapshots import GONE, Snapshot, stale_work

SCHEMA = "k long, n long, v string, _gone boolean"


def files(folder) -> dict[str, set[str]]:
    return {p.name: {f.name for f in p.glob("*.parquet")} for p in pathlib.Path(folder).glob("_bucket=*")}


def test_changes_in_any_order(spark, tmp_path):
    scratch(spark)
    rng = random.Random(5)
    rows = [(rng.choice([*range(30), None]), i, rng.choice(["a", "b", None]), rng.random() < 0.2) for i in range(400)]
    want = {}
    for k, n, v, gone in rows:
        want[k] = (n, v, gone)
    want = {k: (n, v) for k, (n, v, gone) in want.items() if not gone}
    rng.shuffle(rows)
    kept = Snapshot(str(tmp_path / "s"), "k", ("n",), 8)
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    kept.write(frame(rows[:150]))
    kept.apply(frame(rows[150:300]))
    kept.apply(frame(rows[290:] + rows[295:]))
    assert {r.k: (r.n, r.v) for r in kept.read(spark).collect()} == want
    assert kept.read(spark).count() == len(want)
    assert kept.apply(frame(rows)) == [] and kept.apply(frame([])) == []


def test_everything_deleted(spark, tmp_path):
    kept = Snapshot(str(tmp_path / "s"), "k", ("n",), 4)
    kept.write(spark.createDataFrame([(i, 1, "a", False) for i in range(20)], SCHEMA))
    assert len(kept.apply(spark.createDataFrame([(i, 2, None, True) for i in range(20)], SCHEMA))) == 4
    assert kept.read(spark).count() == 0
    assert kept.apply(spark.createDataFrame([(3, 1, "older", False)], SCHEMA)) == []


def test_only_touched_buckets_are_written(spark, tmp_path):
    kept = Snapshot(str(tmp_path / "s"), "id", (), 100, "id div 100")
    base = spark.range(10_000).select("id", (F.col("id") * 2).alias("x"), F.lit(None).cast("string").alias("y"))
    kept.write(base)
    before = files(tmp_path / "s")
    assert len(before) == 100
    changed = base.where("id between 300 and 399").withColumn("x", F.lit(0).cast("long"))
    assert [r.id for r in stale_work(changed, kept).orderBy("id").collect()] == list(range(300, 400))
    assert kept.apply(changed.unionByName(base.where("id between 500 and 9000"))) == [3]
    after = files(tmp_path / "s")
    assert {b for b in before if before[b] != after[b]} == {"_bucket=3"}
    assert kept.read(spark).where("x = 0").count() == 101 and kept.read(spark).count() == 10_000


def test_marks_are_no_columns_of_the_result(spark, tmp_path):
    kept = Snapshot(str(tmp_path / "s"), "k", ("n",), 2)
    kept.write(spark.createDataFrame([], SCHEMA).withColumn(GONE, F.lit(False)).unionByName(spark.createDataFrame([(1, 1, "a", False)], SCHEMA)))
    assert kept.read(spark).columns == ["k", "n", "v"]
