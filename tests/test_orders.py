"""Greedy selection and roll-ups against plain folds."""

import random

import pytest

from veridock.operators import ordered, rules
from veridock.session import scratch


def plain_conflicts(n, pairs):
    before = {}
    for a, b in pairs:
        before.setdefault(b, []).append(a)
    kept = set()
    for i in range(n):
        if not any(a in kept for a in before.get(i, ())):
            kept.add(i)
    return kept


def plain_keys(rows):
    seen, kept = [set(), set()], []
    for o, *keys in rows:
        if all(k is None or k not in s for k, s in zip(keys, seen, strict=True)):
            kept.append(o)
            for k, s in zip(keys, seen, strict=True):
                s.add(k)
    return kept


def jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    work()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("rounds, block", [(0, 1), (0, 7), (1, 40), (3, 500_000)])
def test_greedy(spark, rounds, block):
    scratch(spark)
    dice = random.Random(block)
    n = 25 if block == 1 else 120
    pairs = sorted({tuple(sorted(dice.sample(range(n), 2))) for _ in range(2 * n)})
    items = spark.createDataFrame([(i,) for i in range(n)], "ord long")
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert {r["ord"] for r in ordered.greedy_conflicts(items, edges, rounds=rounds, block=block).collect()} == plain_conflicts(n, pairs)
    rows = [(i, dice.choice([None, *range(n // 3)]), dice.choice([None, *range(n // 3)])) for i in range(n)]
    got = ordered.greedy_two_keys(spark.createDataFrame(rows, "ord long, x long, y long"), "ord", "x", "y", rounds=rounds, block=block)
    assert sorted(r["ord"] for r in got.collect()) == plain_keys(rows)
    assert ordered.greedy_conflicts(items, edges.limit(0)).count() == n and ordered.greedy_two_keys(got.limit(0), "ord", "x", "y").count() == 0


def test_a_long_chain_takes_few_jobs(spark):
    scratch(spark)
    n = 10_000
    items = spark.range(n).withColumnRenamed("id", "ord")
    edges = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    out = []
    used = jobs(spark, "chain", lambda: out.append(ordered.greedy_conflicts(items, edges)))
    assert out[0].count() == n // 2 and used < 60  # a checkpoint is two jobs
    keys = items.selectExpr("ord", "(ord + 1) div 2 AS x", "ord div 2 AS y")
    used = jobs(spark, "keys", lambda: out.append(ordered.greedy_two_keys(keys, "ord", "x", "y")))
    assert sorted(r["ord"] for r in out[1].collect()) == list(range(0, n, 2)) and used < 60


def test_roll_up_has_no_depth(spark):
    n = 1000
    chain = [("r", f"s{i}", f"s{i - 1}" if i else None, 1.0, 1) for i in range(n)]
    odd = [("q", "a", "b", 1.0, 2), ("q", "b", "a", 1.0, 3), ("q", "c", "a", 1.0, 5), ("q", "d", "gone", 1.0, 7), ("q", "e", "d", 1.0, 11), ("q", "f", "d", 1.0, 13)]
    steps = spark.createDataFrame(chain, "run_id string, step string, parent string, seconds double, calls long")
    got = {r["step"]: r["calls"] for r in rules.rolled_up(steps).collect()}
    assert got == {f"s{i}": n - i for i in range(n)}
    got = {r["step"]: r["calls"] for r in rules.rolled_up(spark.createDataFrame(odd, steps.schema)).collect()}
    assert got == {"a": 2, "b": 3, "c": 5, "d": 31, "e": 11, "f": 13}  # a, b in a circle, c below it


def test_clusters_equal_the_fold(spark):
    import math

    rng = random.Random(12)
    groups = {"grid": [i / 4 for i in range(300)], "dense": [rng.random() for _ in range(200)], "wide": [rng.random() * 400 for _ in range(600)], "one": [5.0], None: [3.0, 3.0, 3.5, 9.0, -math.inf, math.inf, math.inf]}
    rows = [(k, v, i) for k, vs in groups.items() for i, v in enumerate(vs)] + [("one", None, 7), ("one", math.nan, 8), ("none", None, 0)]
    scratch(spark)
    df = spark.createDataFrame(rows, "g string, y double, i int").repartition(5)
    for gap in (1.0, 0.3, 30.0):
        got = {(r.g, r.i): r.cluster for r in ordered.clustered(df, ["g"], "y", gap).collect()}
        assert len(got) == len(rows)
        for k, vs in groups.items():
            first, n = None, 0
            for v, i in sorted((v, i) for i, v in enumerate(vs)):
                if first is None or v - first >= gap:
                    first, n = v, n + 1
                assert got[k, i] == n, (gap, k, v)
        assert got["one", 7] is None and got["one", 8] is None and got["none", 0] is None
    assert ordered.clustered(df.limit(0), ["g"], "y", 1.0).count() == 0
    assert ordered.clustered(df.where("g = 'wide'"), [], "y", 1.0).agg({"cluster": "max"}).first()[0] == max(v for (k, _), v in {(r.g, r.i): r.cluster for r in ordered.clustered(df, ["g"], "y", 1.0).collect()}.items() if k == "wide")


def test_one_group_of_a_million_values(spark):
    """All in one group: its blocks are composed, and what meets in one task is a few rows of each."""
    scratch(spark)
    df = spark.range(1_000_000).selectExpr("'a' as g", "cast(id * 7919 % 1000003 as double) as y")
    got = ordered.clustered(df, ["g"], "y", 10.0).groupBy("cluster").agg({"y": "min"}).toDF("c", "y").orderBy("c").collect()
    values = sorted(float(i * 7919 % 1000003) for i in range(1_000_000))
    want = []
    for v in values:
        if not want or v - want[-1] >= 10.0:
            want.append(v)
    assert [(r.c, r.y) for r in got] == list(enumerate(want, 1))
