"""Quotes by index against the exact test on every pair."""

import random

from pyspark.sql import functions as F

from veridock.functions import textnorm as t
from veridock.operators import quoting


def test_quotes(spark):
    texts = spark.createDataFrame([(1, "He said one two three four five six, then left."), (2, "one two three four fivex"), (3, None)], "t int, text string")
    passages = spark.createDataFrame([(1, "one two three four five"), (2, "he said"), (3, "four five six"), (4, ""), (5, None), (6, ",")], "p int, text string")
    assert {(r.t, r.p) for r in quoting.quotes(texts, passages, "t", "text", "p", "text").collect()} == {(1, 1), (1, 2), (1, 3), (1, 6)}


WORDS = ["cover", "up to", "6 months", "36 months", "rs. 5,00,000", "₹ 50,000", "(7)", "care(2)", "ward4", "x-ray", "ray", "5%", "7.5%", "a", "—", "the 31 st", "bonus*", "Air™", "über", "§", "...", "(in `)"]


def test_every_pair(spark):
    dice = random.Random(19)
    some = lambda n: " ".join(dice.choice(WORDS) for _ in range(dice.randrange(1, n)))
    items = []
    for i in range(140):
        text = dice.choice(["", "more ", "Then "]) + some(9)
        items.append((i, text, dice.choice([None, "Footnotes", some(4)]), dice.choice([text, text.replace("(7)", "   ").replace("ward4", "ward ")])))
    cut = lambda s: " ".join(s.split()[dice.randrange(3) : dice.randrange(3, 12)])
    passages = [(i, dice.choice([some(8), cut(dice.choice(items)[1]), cut(f"{(x := dice.choice(items))[2]} {x[1]}")])) for i in range(160)]
    left = spark.createDataFrame(items, "i int, text string, head string, bare string")
    right = spark.createDataFrame(passages, "p int, quote string")
    want = left.crossJoin(right).where(t.quoted_in_item("quote", "text", F.coalesce("head", F.lit("Footnotes")), "bare")).select("i", "p")
    got = quoting.quotes(left, right, "i", "text", "p", "quote", heading="head", unmarked="bare")
    pairs = {tuple(r) for r in want.collect()}
    assert len(pairs) > 500 and {tuple(r) for r in got.collect()} == pairs
    assert got.count() == len(pairs)


def test_no_regular_expression_over_texts_and_one_normal_form_each(spark):
    """Long quotes: the plan over stored views reads words, and compares as many as the quote has."""
    left = spark.createDataFrame([(1, "one two three four five six seven")], "i int, text string")
    right = spark.createDataFrame([(1, "two three four five six")], "p int, quote string")
    plan = quoting.quotes(left, right, "i", "text", "p", "quote")._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(words" in plan and "regexp_replace" not in plan and "Cartesian" not in plan
