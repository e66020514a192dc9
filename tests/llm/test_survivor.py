"""Golden records against a fold over each cluster's rows."""

import datetime as dt
import math
import random
import re

from veridock.llm import survivor

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
DAY = dt.timedelta(days=1)
NOON = dt.datetime(2024, 5, 1, 12)


def plain(rows):
    """cluster -> the record, by sorting the whole cluster for each field."""
    text = lambda s: s if s is not None and re.search(r"[^\x20\x09-\x0D]", s) else None
    clusters = {}
    for cid, master, source, at, *fields in rows:
        name, email, city, nation, segment, balance = fields
        rank = survivor.TRUST.index(source) if source in survivor.TRUST else 4
        balance = None if balance is None or not math.isfinite(balance) else balance
        clusters.setdefault(cid if master is None else master, []).append({"id": cid, "rank": rank, "at": at, "name": text(name), "email": text(email), "city": text(city), "nation": nation, "segment": text(segment), "balance": balance})
    out = {}
    for k, own in clusters.items():
        latest = max((r["at"] for r in own if r["at"]), default=None)
        for r in own:
            r["stale"] = r["at"] is None or latest - r["at"] > 30 * DAY
        recent = lambda r: (r["at"] is None, -(r["at"] - dt.datetime(1970, 1, 1)).total_seconds() if r["at"] else 0, r["rank"], r["id"] is None, r["id"] or 0)
        trusted = lambda r: (r["stale"], r["rank"], *recent(r))
        pick = lambda key, has: min((r for r in own if has(r)), key=key, default={})
        seg = pick(recent, lambda r: r["segment"])
        mail = pick(trusted, lambda r: r["email"])
        name = pick(lambda r: (-len(r["name"]), *trusted(r)), lambda r: r["name"])
        place = pick(lambda r: (-(r["city"] is not None) - (r["nation"] is not None), *trusted(r)), lambda r: True)
        money = pick(lambda r: (r["segment"] != seg.get("segment"), *recent(r)), lambda r: r["balance"] is not None)
        some = place["city"] is not None or place["nation"] is not None
        out[k] = (len(own), sum(r["stale"] for r in own), name.get("name"), mail.get("email"), seg.get("segment"), place["city"], place["nation"], money.get("balance"), name.get("id"), mail.get("id"), seg.get("id"), money.get("id"), place["id"] if some else None)
    return out


def found(spark, rows):
    df = survivor.golden_records(spark.createDataFrame(rows, SCHEMA))
    got = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def test_against_a_plain_fold(spark):
    dice = random.Random(7)
    some = lambda *xs: dice.choice(xs)
    rows = []
    for i in range(900):
        at = some(None, *(NOON - k * 10 * DAY for k in range(6)), NOON - 30 * DAY - dt.timedelta(microseconds=1))
        rows.append((i, some(None, 1, 1, 1, dice.randrange(150)), some("partner", "store", "web", "crm", "other", None), at, some(None, "", " \t", "ab", "é日本", "abc "), some(None, "a@b", "c@d", "\n"), some(None, "X", "Y", ""), some(None, 1, 2), some(None, "s", "t", " "), some(None, 1.005, -2.5, 0.0, math.nan, math.inf, -math.inf)))
    assert found(spark, rows) == plain(rows)


def test_cases(spark):
    rows = [
        (1, None, "crm", NOON, "A", None, None, None, None, 3.0),
        (1, None, "crm", NOON, "A", None, None, None, None, 3.0),  # a repeated row counts twice
        (None, None, "web", None, "B", " ", None, None, "s", None),  # no id at all
        (3, 9, "partner", NOON - 30 * DAY, None, "old", None, None, "s", 1.0),  # exactly 30 days: fresh
        (4, 9, "web", NOON, None, "new", None, None, None, 2.0),
        (5, 9, "web", NOON - 31 * DAY, None, None, None, None, "t", 7.0),
    ]
    got = found(spark, rows)
    assert got == plain(rows)
    assert got[1][0] == 2 and got[None][1] == 1 and got[9][3] == "old" and got[9][7] == 1.0
    assert found(spark, []) == {}


def test_other_columns_do_not_clash(spark):
    rows = [(1, 1, "crm", NOON, "A", None, None, None, None, 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for extra in ("_k", "stale", "field", "best", "trust", "part"):
        df = df.withColumn(extra, df.client_id)
    assert survivor.golden_records(df).count() == 1


def test_a_large_cluster_meets_in_many_tasks(spark):
    rows = survivor.cleaned(spark.range(5000).selectExpr("id AS client_id", "1L AS master_id", "'web' AS source", "current_timestamp() AS updated_at", "'n' AS name", "'e' AS email", "'c' AS city", "1 AS nation_id", "'s' AS segment", "1.0D AS balance"))
    salted = survivor.aged(rows).groupBy("_salt").count().collect()
    assert len(salted) == survivor.SALTS and max(r["count"] for r in salted) < 200
