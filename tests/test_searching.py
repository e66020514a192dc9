"""Keyword search against scoring every pair."""

import random

from tests.conftest import DATA
from pyspark.sql import functions as F

from veridock.functions import textnorm as t
from veridock.operators import searching
from veridock.session import table


def plain(queries, docs, k):
    out = []
    for q, asked in queries:
        scores = sorted((-len(set(asked or ()) & set(words or ())), d) for d, words in docs)
        out += [(q, place, d, -s) for place, (s, d) in enumerate([x for x in scores if x[0]][:k], 1)]
    return sorted(out)


def test_every_pair(spark):
    dice = random.Random(2)
    vocabulary = [f"w{int(30 * dice.random() ** 2)}" for _ in range(200)]
    some = lambda n: dice.choices(vocabulary, k=dice.randrange(n))
    docs = [(d, some(25)) for d in range(300)] + [(900, None), (901, [])]
    queries = [(q, some(14)) for q in range(30)] + [(50, None), (51, []), (52, ["unknown"]), (53, ["w0", "w0"])]
    left = spark.createDataFrame(queries, "q int, words array<string>")
    right = spark.createDataFrame(docs, "d int, words array<string>")
    for k in (1, 5, 400):
        assert sorted(tuple(r) for r in searching.top_k(left, right, "q", "words", "d", "words", k).collect()) == plain(queries, docs, k)
    assert searching.top_k(left, right.limit(0), "q", "words", "d", "words").count() == 0


def test_few_lists_are_read(spark):
    """The frequent words, which have most places, are left aside."""
    docs = table(spark, DATA, "documents").select("doc_id", t.tokens("text").alias("words"))
    words = docs.select(F.col("doc_id").alias("doc"), F.array_distinct("words").alias("words"))
    queries = table(spark, DATA, "benchmark").select("item_id", t.tokens("text").alias("words"))
    terms = searching.ranked_terms(queries, words, "item_id", "words")
    everything = searching._lists(words, terms).agg(F.sum("n")).first()[0]
    best = searching.top_k(queries, docs, "item_id", "words", "doc_id", "words").groupBy(F.col("item_id").alias("query")).agg(F.min("score").cast("int").alias("bound"))
    read = searching._lists(words, searching.read_lists(terms, best).where("read")).agg(F.sum("n")).first()[0]
    assert read < everything / 2
