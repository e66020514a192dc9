"""Checks as rows: each check alone, what is worst, and odd rows."""

import pytest

from veridock.operators import checks
from veridock.session import scratch

ITEMS = [
    ("E1", "A", True, "Room rent is paid up to INR 5,000 after 24 months"), ("E2", "B", True, "Room rent is paid"), ("E3", "A", False, "Room rent is paid"),
    ("E4", "A", True, "Cover is unlimited at 80%"), ("E5", "A", True, None),
]
# claim, text, reviewer's status, citations | status, number check, failed
CLAIMS = [
    ("good", "INR 5,000 after 2 years", "VERIFIED", [("E1", "room RENT is paid")], "VERIFIED", "PASS", []),
    ("kept", "It pays", "CONTRADICTED", [("E1", "room rent is paid")], "CONTRADICTED", "NA", []),
    ("none", "It pays", None, [], "NEEDS_REVIEW", "NA", []),
    ("foreign", "It pays", "VERIFIED", [("E1", "room rent"), ("E2", None)], "UNSUPPORTED", "NA", ["ownership"]),
    ("uncitable", "It pays", "VERIFIED", [("E3", "room rent")], "UNSUPPORTED", "NA", ["ownership"]),
    ("unknown", "It pays", "VERIFIED", [("ZZ", "room rent")], "UNSUPPORTED", "NA", ["ownership"]),
    ("uncited", "It pays", "VERIFIED", [], "UNSUPPORTED", "NA", ["ownership"]),
    ("unquoted", "It pays", "VERIFIED", [("E1", None)], "NEEDS_REVIEW", "NA", ["quotes"]),
    ("misquoted", "It pays", "VERIFIED", [("E1", "room rent"), ("E4", "room rent")], "NEEDS_REVIEW", "NA", ["quotes"]),
    ("part", "It pays", "VERIFIED", [("E1", "oom rent is")], "NEEDS_REVIEW", "NA", ["quotes"]),
    ("wrong", "INR 9,000", "VERIFIED", [("E1", "room rent")], "CONTRADICTED", "FAIL_CONTRADICTED", ["numbers"]),
    ("unstated", "At 80%", "VERIFIED", [("E1", "room rent")], "UNSUPPORTED", "FAIL_MISSING", ["numbers"]),
    ("both", "INR 5,000 at 80%", "VERIFIED", [("E1", "room rent"), ("E4", "unlimited")], "VERIFIED", "PASS", []),
    ("one", "INR 5,000 at 90%", "VERIFIED", [("E1", "room rent"), ("E4", "unlimited")], "CONTRADICTED", "FAIL_CONTRADICTED", ["numbers"]),
    ("absolute", "Unlimited cover, always", "VERIFIED", [("E4", "unlimited")], "NEEDS_REVIEW", "NA", ["absolute"]),
    ("backed", "Unlimited cover", "VERIFIED", [("E4", "unlimited"), ("E4", "unlimited"), ("E5", None)], "VERIFIED", "NA", []),
    ("all", "Unlimited cover of INR 7,000", "VERIFIED", [("E1", "cover"), ("E2", "x")], "CONTRADICTED", "FAIL_CONTRADICTED", ["ownership", "quotes", "numbers", "absolute"]),
    ("null", None, "VERIFIED", [("E5", "x")], "NEEDS_REVIEW", "NA", ["quotes"]),
    (None, "It pays", "VERIFIED", [], "UNSUPPORTED", "NA", ["ownership"]),
]
TYPES = ("claim_id string, text string, status string, holder string, form string", "claim_id string, evidence_id string, quote string", "evidence_id string, owner string, citable boolean, text string, claim_id string")


@pytest.fixture(scope="module")
def tables(spark):
    scratch(spark)
    claims = spark.createDataFrame([(n, x, s, "extra", "extra") for n, x, s, *_ in CLAIMS], TYPES[0]).selectExpr("*", "'A' as owner")
    citations = spark.createDataFrame([(n, *c) for n, _, _, cited, *_ in CLAIMS for c in cited], TYPES[1])
    return claims, citations, spark.createDataFrame([(*x, "extra") for x in ITEMS], TYPES[2])


def test_each_check(tables):
    got = {r.claim_id: (r.status, r.number_check, r.failed) for r in checks.audited(*tables).collect()}
    assert got == {n: tuple(rest) for n, _, _, _, *rest in CLAIMS}


def test_empty_tables(tables):
    claims, citations, evidence = tables
    assert checks.audited(claims.limit(0), citations, evidence).count() == 0
    bare = {r.claim_id: r.failed for r in checks.audited(claims, citations.limit(0), evidence.limit(0)).collect()}
    assert bare["good"] == ["ownership", "numbers"] and bare["none"] == [] and bare["kept"] == []
