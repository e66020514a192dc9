"""Keyword search: the texts that share most words with each query, without scoring what cannot be among the best.

A score is the number of shared words, so a word adds one at most. Words are ordered by how many texts have them, the rarest first.

1. Seed: the rarest third of each query's words finds texts; the ``k`` that have most of them are scored in full. The least of
   these scores is a bound: at least ``k`` texts reach it.
2. A text that reaches the bound has at least ``NEED`` words of the query besides its most frequent ones, if so many of these are
   left aside that they cannot make up for it. Only the lists of the other words are read; the frequent words, whose lists are
   nearly all of the index, are not.
3. What has enough of those words is scored in full, and ranked.

Lists are read by an equality join on the word; a text's words travel once for each candidate. Texts that share no word are no
results; ties go to the smaller id. Queries without words, and null texts, have no results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veridock.operators import ordered
from veridock.session import stored

#: Words that a text needs from the lists that are read.
NEED = 3


def _lists(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, doc, n): how many of the asked words (query, word) each text has."""
    return words.select("doc", F.explode("words").alias("word")).join(asked.select("query", "word"), "word").groupBy("query", "doc").agg(F.count("*").alias("n"))


def _scored(pairs: DataFrame, words: DataFrame, rest: DataFrame) -> DataFrame:
    """(query, doc, score): the words found already and those of ``rest`` (query, others) that the text has."""
    full = pairs.join(words, "doc").join(rest, "query", "left")
    return full.select("query", "doc", (F.col("n") + F.coalesce(F.size(F.array_intersect("others", "words")), F.lit(0))).alias("score"))


def _others(terms: DataFrame, which) -> DataFrame:
    return terms.where(which).groupBy("query").agg(F.collect_list("word").alias("others"))


def ranked_terms(queries: DataFrame, words: DataFrame, query: str, tokens: str) -> DataFrame:
    """(query, word, place, n): a query's words by rising number of texts that have them; stored. Words of no text are gone."""
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(tokens)).alias("word"))
    counts = words.select(F.explode("words").alias("word")).join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    w = W.partitionBy("query")
    terms = asked.join(counts, "word").withColumn("place", F.row_number().over(w.orderBy("df", "word"))).withColumn("n", F.count("*").over(w))
    return stored(terms.select("query", "word", "place", "n"))


def read_lists(terms: DataFrame, bounds: DataFrame) -> DataFrame:
    """(query, word, place, n, need, read): which lists a bound asks for. With t frequent words left aside a text needs bound - t of
    the others; t is as large as that leaves ``NEED``, or all that is needed."""
    t = F.greatest(F.col("bound") - NEED, F.lit(0))
    each = terms.join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(1)))
    each = each.withColumn("need", F.greatest(F.col("bound") - t, F.lit(1)))
    return each.withColumn("read", F.col("place") <= F.col("n") - t)


def top_k(queries: DataFrame, docs: DataFrame, query: str, query_tokens: str, doc: str, doc_tokens: str, k: int = 15) -> DataFrame:
    """(query, rank, doc, score): the ``k`` texts of the highest scores for each query. Tokens are arrays of words."""
    words = stored(docs.select(F.col(doc).alias("doc"), F.array_distinct(doc_tokens).alias("words")).where("size(words) > 0"))
    terms = ranked_terms(queries, words, query, query_tokens)
    rare = F.col("place") * 3 <= F.col("n") + 2
    seed = ordered.quota(_lists(words, terms.where(rare)), ["query"], [F.desc("n"), "doc"], k, "place").select("query", "doc", "n")
    reached = _scored(seed, words, _others(terms, ~rare)).groupBy("query").agg(F.min("score").cast("int").alias("bound"), F.count("*").alias("found")).where(F.col("found") >= k)
    lists = stored(read_lists(terms, reached.select("query", "bound")))
    need = lists.select("query", "need").distinct()
    found = _lists(words, lists.where("read")).join(need, "query").where("n >= need").drop("need")
    score = _scored(found, words, _others(lists, ~F.col("read")))
    best = ordered.quota(score, ["query"], [F.desc("score"), "doc"], k, "rank")
    return best.select(F.col("query").alias(query), "rank", F.col("doc").alias(doc), F.col("score").cast("long").alias("score"))
