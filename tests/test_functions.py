"""Golden cases for normalisation, quotes, names and quantities, written from their described behaviour."""

import pytest
from pyspark.sql import functions as F

from veridock.functions import hashing as h
from veridock.functions import markers as m
from veridock.functions import quantity as q
from veridock.functions import textnorm as t


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("text, expected", [
    ("Cover  of ₹5,000", "cover of inr 5,000"),
    ("Rs. 500 per day", "inr 500 per day"),
    ("`500 and Fee`", "inr 500 and fee"),
    ("the 31 st day", "the 31st day"),
    ("Lock(1) rate", "lock rate"),
    ("Care OPD9 benefit", "care opd benefit"),
    ("“Smart” – choice’s", '"smart" - choice\'s'),
    ("Straße", "strasse"),
    ("Maternity cover %", "maternity cover"),
    ("30% of it*", "30% of it"),
    ("Plan™", "plan tm"),
    ("", ""),
])
def test_normalised(spark, text, expected):
    assert one(spark, t.normalised("x"), x=text) == expected


@pytest.mark.parametrize("quote, text, expected", [
    ("6 months", "a wait of 36 months", False),
    ("6 months", "a wait of 6 months.", True),
    ("50,000", "up to 2,50,000", False),
    ("5%", "7.5% of it", False),
    ("5%", "only 5% of it", True),
    ("INR 2,50", "₹2,50,000", False),
    ("up to ₹500", "Up to Rs.500 a day", True),
    ("Care (90)", "Care (60 days)", False),
    ("Care (7) plan", "Care (7) plan", True),
    ("", "anything", False),
    ("a.b", "axb", False),
])
def test_quotes(spark, quote, text, expected):
    assert one(spark, t.quoted_in("a", "b"), a=quote, b=text) is expected


ALIASES = {"P1": ["golden shield"], "P2": ["golden shield+", "bluecare"]}


@pytest.mark.parametrize("text, found", [("Golden Shield is", ["P1"]), ("Golden Shield+ is", ["P2"]), ("xbluecare", []), ("bluecare and golden shield", ["P1", "P2"])])
def test_names(spark, text, found):
    assert one(spark, t.names(ALIASES, t.normalised("x")), x=text) == found


def test_other_text(spark):
    x = "The company in India grows. Its Google Cloud team, says ACME, is big."
    assert one(spark, t.proper_names("x"), x=x) == ["India", "Google", "Cloud"]
    assert one(spark, t.stems("x"), x="Employees employed about Indian staff") == ["emplo", "india", "staff"]
    assert one(spark, t.url_key("x"), x="HTTPS://www.A.com/b/?q=1#z") == "a.com/b"
    assert one(spark, t.site_name("x"), x="http://en.a.com/b") == "a.com"
    assert [one(spark, t.slug("x"), x=v) for v in ("A & B Ltd.", "--")] == ["a-b-ltd", "company"]
    assert [one(spark, t.unlabelled("x"), x=v) for v in ("So*", "So (Assumption)", "So")] == ["So"] * 3
    assert one(spark, t.required_words("x"), x="Must keep 'Exact' and *word*") == ["exact", "word"]
    assert one(spark, t.bullets("x"), x="one two • ab • three four") == ["one two", "three four"]
    assert one(spark, t.footnotes("x"), x="First one. (2) Second one. 3 Third.") == ["First one.", "(2) Second one.", "3 Third."]
    assert one(spark, t.clean_title("x", "s"), x="annual-report_2024.pdf", s="site") == "annual report 2024"
    assert one(spark, t.clean_title("x", "s"), x="", s="site") == "site"
    assert tuple(one(spark, t.backtick_kinds("x"), x="`500 and [`] or 4` years, it`s")) == (2, 1, 1)
    assert one(spark, t.rupees_shown("x"), x="`500 it`s") == "₹500 it`s"
    assert one(spark, t.masked(["Golden"], F.col("x")), x="a Golden plan") == "a        plan"
    assert one(spark, m.distinct(m.spans(F.col("x"), F.col("k"))), x="Cover(7) and Care OPD9", k=["7", "9", "5"]) == ["7", "9"]
    assert one(spark, t.precise_figures("x"), x="It has 12,345 employees, over 9,000 clients, since 1999") == ["12,345"]
    assert one(spark, t.tokens("x"), x="The Cover of 5 days, cover") == ["cover", "5", "days"]
    assert one(spark, h.map_key(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))), x="") == '{"a":2,"b":1}'
    assert one(spark, h.list_hash(F.array(F.lit("b"), F.lit("a"))), x="") == one(spark, h.list_hash(F.array(F.lit("a"), F.lit("b"))), x="")
    assert one(spark, h.short_hash(F.col("x"), F.lit(None)), x="a") != one(spark, h.short_hash(F.col("x"), F.lit("-")), x="a")


READINGS = [
    ("Wait of 36 months", True, [(36, "MONTHS")]),
    ("INR 10/15/20 Lakhs", True, [(1e6, "INR"), (1.5e6, "INR"), (2e6, "INR")]),
    ("₹20,000 to ₹1 lakh", True, [(20000, "INR"), (100000, "INR")]),
    ("₹25,000 and 65%", True, [(25000, "INR"), (65, "PERCENT")]),
    ("ages 35 & 30", True, [(35, "YEARS"), (30, "YEARS")]),
    ("10-20%", True, [(10, "PERCENT"), (20, "PERCENT")]),
    ("List 1, 2, 3", True, []),
    ("Awards 2025", True, []),
    ("grown by 2025", False, []),
    ("2025 clients", False, [(2025, "COUNT")]),
    ("Sum Insured4", True, []),
    ("Sum Insured4", False, [(4, "COUNT")]),
    ("24x7 help", False, []),
    ("30 mins", True, [(0.5, "HOURS")]),
    ("10X bonus, 5 times", True, [(10, "MULTIPLIER"), (5, "MULTIPLIER")]),
    ("2 Crore+ Lives", True, [(2e7, "COUNT")]),
    ("₹500K", True, [(500000, "INR")]),
    ("Up to 3 day care", True, [(3, "COUNT")]),
    ("call 1800 270 7000", True, []),
    ("400 059", True, []),
    ("1. Max. 4 a year 2. Max. 5", True, [(4, "COUNT"), (5, "COUNT")]),
    ("Day 1 cover", True, [(1, "DAYS")]),
    ("2A2C", True, [(2, "COUNT"), (2, "COUNT")]),
    ("1st March 2026", True, []),
    ("", True, []),
    (None, True, []),
]


def test_quantities(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(READINGS)]
    df = spark.createDataFrame(rows, "i int, text string").select("i", q.quantities(F.col("text")).alias("s"), q.quantities(F.col("text"), False).alias("c"))
    got = {r["i"]: r for r in df.collect()}
    for i, (text, strict, expected) in enumerate(READINGS):
        assert [(x["value"], x["unit"]) for x in got[i]["s" if strict else "c"]] == expected, text


@pytest.mark.parametrize("text, expected", [
    ("For SI below `15 lac", [(0, 1.5e6, False, True)]),
    ("Sum Insured from INR 50 Lacs to INR 6 Crores", [(5e6, 6e7, False, False)]),
    ("For BSI INR 50 Lacs and 75 Lacs", [(5e6, 5e6, False, False), (7.5e6, 7.5e6, False, False)]),
    ("BSI INR 1 Cr and Above", [(1e7, float("inf"), False, False)]),
    ("Between INR 7.5 Lacs to INR 15 Lac Base SI", [(7.5e5, 1.5e6, False, False)]),
    ("Maternity up to INR 1 Lac", []),
    ("", []),
])
def test_ranges(spark, text, expected):
    found = spark.createDataFrame([(text,)], "text string").select(q.sum_insured_ranges(F.col("text"))).first()[0]
    assert [tuple(r) for r in found] == expected


def test_quantity_columns(spark):
    df = spark.createDataFrame([("over 2 years", "a wait of 24 months"), ("2 years", "36 months"), ("98%", "99%"), ("5 days", "no day"), ("none", "7 days"), ("₹22,616", "₹22,700")], "c string, e string")
    both = df.select(q.quantities(F.col("c"), False).alias("c"), q.quantities(F.col("e")).alias("e"))
    out = both.select(q.number_check(F.col("c"), F.col("e")).alias("r"), q.unstated(F.col("c"), F.col("e")).alias("u")).collect()
    assert [r.r for r in out] == ["PASS", "FAIL_CONTRADICTED", "FAIL_CONTRADICTED", "FAIL_MISSING", "NA", "PASS"]
    assert out[1].u == ["2 years"]
    units = spark.createDataFrame([("(in Lakhs)",), ("Amount",), ("No. of days",), ("x",)], "l string").select(q.header_unit(F.col("l")).alias("u")).collect()
    assert [u.u and tuple(u.u) for u in units] == [("INR", 1e5), ("INR", 1.0), ("DAYS", 1.0), None]
    shown = spark.createDataFrame([(100000.0,), (250000.5,), (-999.0,), (21700000000.0,)], "v double").select(q.grouped_indian(F.col("v")).alias("s")).collect()
    assert [s.s for s in shown] == ["1,00,000", "2,50,000.5", "-999", "21,70,00,00,000"]
    segments = spark.createDataFrame([("Row (60 days)", "A | B", "5"), ("Row", "A", "Row 5")], "r string, c string, t string").select(q.label_segments(F.col("r"), F.col("c"), F.col("t")).alias("s")).collect()
    assert [s.s for s in segments] == [["Row (60 days)", "A", "B"], ["A"]]
