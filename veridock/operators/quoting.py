"""Verbatim quotes: which items quote which passages, found by an index instead of a scan.

1. An item is read in up to three views: its text, its text without the footnote markers recorded for it, and, where the text goes on
   from its heading in lower case, both together. The normal form takes most of the time, so only views that may quote something are
   brought into it, once, and stored as words. It neither drops, splits nor joins runs of the letters a-z (but for ``textnorm.MADE``), so a
   view that has a quote has the quote's runs next to each other even before; up to three of each quote are looked for in all views.
2. A quote that stands in a view cuts no word but its first and last, so the words between stand there as they are. Every quote
   gives the triples of its inner words; places of these triples, and of no others, are counted in the views. Quotes of
   fewer than five words give their first run of letters and digits instead; which words have these runs is read from the distinct words.
3. Each quote is looked up by its rarest triple alone. Triple and place say where the quote would begin, so it is compared
   with as many words from there, never with the text.

Keys of quotes go to the views, so that neither texts nor their words are shuffled, but counts, distinct words and what is found; only
where there are more than ``FEW`` quotes are places shuffled and joined to their views. Quotes without letters and digits have
no key and are compared with every view; they are rare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions import textnorm as t
from veridock.session import stored

TEXT, UNMARKED, WITH_HEADING = range(3)
#: Words from which on a quote has inner triples.
LONG = 5
#: Keys or quotes up to which they are sent to the views.
FEW = 100_000
#: Runs of a quote that all views are searched for, the letters they have together for that to spare anything, and rows searched at once.
TOGETHER, TELLING, AT_ONCE = 3, 8, 2000
_PAREN = r"(\(\d{1,2}\))"
_RUN = r"([\p{L}\p{N}]+)"


def _words(text: Column, keep_paren: bool = False) -> Column:
    return F.split(t.normalised(text, keep_paren), " ")


def _parens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_PAREN)))


def anchors(quotes: DataFrame) -> list[tuple[str, ...]] | None:
    """Of each quote the most, up to ``TOGETHER``, and longest runs of letters that stand next to each other in whatever quotes it. None, so that
    every view is read, where a quote has none of ``TELLING`` letters, as most views have "the", or where there are more than ``FEW``."""
    runs, size = F.col("runs"), F.size("runs")

    def longest(n: int) -> Column:
        each = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice(runs, i, n)))
        fit = F.filter(each, lambda some: (F.length(F.array_join(some, "")) >= TELLING) & ~F.exists(some, lambda r: r.rlike(t.MADE)))
        return F.array_max(F.transform(fit, lambda some: F.struct(F.length(F.array_join(some, "")).alias("n"), some.alias("runs"))))["runs"]

    found = quotes.select(F.regexp_extract_all(F.array_join("words", " "), F.lit("([a-z]+)")).alias("runs"))
    rows = found.select(F.coalesce(*[longest(n) for n in range(TOGETHER, 0, -1)]).alias("anchor")).distinct().limit(FEW + 1).collect()
    return None if len(rows) > FEW or any(r.anchor is None for r in rows) else [tuple(r.anchor) for r in rows]


def letter_runs(texts: pa.Array) -> pa.ListArray:
    """The runs of letters a-z that texts have in their normal form, read from the texts as they are."""
    texts = pc.ascii_lower(texts).cast(pa.binary())
    for char, letters in t.LETTERED.items():
        texts = pc.replace_substring(texts, char.encode(), letters.encode())
    return pc.split_pattern_regex(texts, "[^a-z]+")


def _having(known: list[tuple[str, ...]], column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps rows whose text has one of the known rows of runs. Runs are numbered, so what is looked up is a number for each place."""
    words = sorted({w for k in known for w in k})
    number = {w: i for i, w in enumerate(words)}
    code = lambda of: sum(x * len(words) ** i for i, x in enumerate(of))
    wanted = {n: np.array(sorted({code([number[w] for w in k]) for k in known if len(k) == n}), np.int64) for n in {len(k) for k in known}}

    def rows(texts: pa.Array) -> np.ndarray:
        runs = letter_runs(texts)
        ids = pc.index_in(runs.flatten(), value_set=pa.array([w.encode() for w in words], pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        found = []
        for n, codes in wanted.items():
            parts = [ids[i : len(ids) - n + 1 + i] for i in range(n)] if len(ids) >= n else [ids[:0]] * n
            at = np.flatnonzero(np.logical_and.reduce([x >= 0 for x in parts]))
            found.append(at[np.isin(code([x[at] for x in parts]), codes)])
        # runs of two texts beside each other may look like one row of runs: that text is kept for nothing
        return np.unique(np.searchsorted(runs.offsets.to_numpy(), np.concatenate(found), side="right") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows if known else 0, AT_ONCE):
                some = batch.slice(first, AT_ONCE)
                yield some.take(pa.array(rows(some.column(column)), pa.int64()))

    return run


def views(items: DataFrame, item: str, text: str, heading: str | None = None, unmarked: str | None = None, known: list[tuple[str, ...]] | None = None) -> DataFrame:
    """id, item, words, parens, stored. Texts that are null have no view, nor have, where ``known`` is given, those without any of these ``anchors``."""
    raw = [F.struct(F.lit(TEXT).alias("view"), F.col(text).alias("raw"))]
    if unmarked:
        raw.append(F.when(F.col(unmarked) != F.col(text), F.struct(F.lit(UNMARKED).alias("view"), F.col(unmarked).alias("raw"))))
    if heading:
        goes_on = F.col(text).rlike(r"^\p{Ll}") & F.col(heading).isNotNull() & ~F.col(heading).isin(*t.APART)
        raw.append(F.when(goes_on, F.struct(F.lit(WITH_HEADING).alias("view"), F.concat_ws(" ", heading, text).alias("raw"))))
    each = items.select(F.col(item).alias("item"), F.explode(F.array_compact(F.array(*raw))).alias("v")).select("item", "v.raw").where("raw is not null")
    if known is not None:
        each = each.mapInArrow(_having(known, "raw"), each.schema)
    return stored(each.select(F.monotonically_increasing_id().alias("id"), "item", _words(F.col("raw")).alias("words"), _parens(F.col("raw")).alias("parens")))


def wanted(passages: DataFrame, passage: str, text: str) -> DataFrame:
    """quote, passage, words, parens, kept, stored. A quote with "(n)" has two forms: without, for views that have the same "(n)", and with
    (``kept``), for the others."""
    forms = F.array(F.lit(False), F.lit(True))
    rows = passages.select(F.col(passage).alias("passage"), F.col(text).alias("raw"), _parens(F.col(text)).alias("parens"), F.explode(forms).alias("kept")).where("not kept or size(parens) > 0")
    rows = rows.select("passage", "parens", "kept", F.when(F.col("kept"), t.normalised("raw", keep_paren=True)).otherwise(t.normalised("raw")).alias("norm"))
    return stored(rows.where("norm <> ''").select(F.monotonically_increasing_id().alias("quote"), "passage", "parens", "kept", F.split("norm", " ").alias("words")))


def _triples(first: int, last: Column) -> Column:
    """(place, key) of the triples of words from ``first`` on; ``last`` is the last place a triple may begin at."""
    word = lambda i: F.element_at("words", i + 1)
    at = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("place"), F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("key")))


def _runs(word: Column, place: Column) -> Column:
    """(place, key) of the runs of a word. The leading 1 keeps them apart from triples."""
    return F.transform(F.regexp_extract_all(word, F.lit(_RUN)), lambda r: F.struct(place.alias("place"), F.xxhash64(F.lit(1), r).alias("key")))


def keys(quotes: DataFrame) -> DataFrame:
    """quote, size, place, key: what each quote can be looked up by."""
    size = F.size("words").alias("size")
    long = quotes.where(F.size("words") >= LONG).select("quote", size, F.explode(_triples(1, F.size("words") - 4)).alias("k"))
    runs = F.transform("words", lambda w, i: _runs(w, i))
    short = quotes.where(F.size("words") < LONG).select("quote", size, F.element_at(F.filter(F.flatten(runs), lambda k: k["place"].isNotNull()), F.lit(1)).alias("k"), F.size(F.flatten(runs)).alias("n"))
    return long.unionByName(short.where("n > 0").drop("n")).select("quote", "size", "k.place", "k.key")


def _sent(df: DataFrame) -> tuple[DataFrame, bool]:
    """A table, to be sent to what it is joined with if it is short, and whether it is."""
    few = df.limit(FEW + 1).count() <= FEW
    return (F.broadcast(df) if few else df), few


def by_word(seen: DataFrame, known: DataFrame) -> DataFrame:
    """word, key, stored: the words of the views in which a known run stands."""
    each = seen.select(F.explode("words").alias("word")).distinct()
    found = each.select("word", F.explode(F.array_distinct(F.transform(_runs(F.col("word"), F.lit(0)), lambda k: k["key"]))).alias("key"))
    return stored(found.join(_sent(known.select("key").distinct())[0], "key").select("word", "key"))


def places(seen: DataFrame, carried: list[str], known: DataFrame, runs: DataFrame | None) -> DataFrame:
    """What is carried of a view, ``at`` and the columns of ``known`` for each place of a known key. Words are taken by their number, so that
    Spark compiles it and no place is a row before it is known to matter."""
    known, word = _sent(known)[0], lambda i: F.get("words", F.col("at") + i)
    at = lambda least: seen.where(F.size("words") >= least).select(*carried, *({"words"} - {*carried}), F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("at"))
    found = at(3).select(*carried, "at", F.xxhash64(word(0), word(1), word(2)).alias("key")).join(known, "key")
    if runs is not None:
        held = at(1).select(*carried, "at", word(0).alias("word")).join(_sent(runs)[0], "word").drop("word")
        found = found.unionByName(held.join(known, "key"))
    return found


def rarest(known: DataFrame, counts: DataFrame) -> DataFrame:
    """quote, size, place, key: of each quote the key with the fewest places; quotes with a key that stands nowhere are gone."""
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "key")).alias("k")
    return known.join(counts, "key", "left").groupBy("quote", "size").agg(least).where("k.n > 0").select("quote", "size", "k.place", "k.key")


def _fits(quote: Column, there: Column, parens: Column, kept: Column, has: Column) -> Column:
    """Whether a quote stands in as many words of a view, and in the form that the view asks for."""
    missing = F.size(F.array_except(parens, has)) > 0
    return (missing == kept) & t.bounded_in(F.array_join(quote, " "), F.array_join(there, " "))


def quotes(items: DataFrame, passages: DataFrame, item: str, text: str, passage: str, quote: str, heading: str | None = None, unmarked: str | None = None) -> DataFrame:
    """(item, passage) of passages that an item quotes verbatim."""
    asked = wanted(passages, passage, quote)
    seen = views(items, item, text, heading, unmarked, anchors(asked))
    known = stored(keys(asked))
    short = not asked.where(F.size("words") < LONG).isEmpty()
    runs = by_word(seen, known) if short else None
    counts = places(seen, [], known.select("key").distinct(), runs).groupBy("key").agg(F.count("*").alias("n"))
    near, few = _sent(stored(rarest(known, counts)))
    begins = (F.col("at") - F.col("place")).alias("at")
    if few:
        there = places(seen, ["item", "words", "parens"], near, runs)
    else:
        there = places(seen, ["id"], near, runs).join(seen, "id")
    there = there.select("item", "quote", "words", F.col("parens").alias("has"), "size", begins).where("at >= 0")
    there = there.select("item", "quote", "has", F.slice("words", F.col("at") + 1, F.col("size")).alias("there")).join(asked, "quote")
    out = there.where(_fits(F.col("words"), F.col("there"), F.col("parens"), F.col("kept"), F.col("has"))).select("item", "passage")
    signs = asked.join(known.select("quote").distinct(), "quote", "left_anti")
    if not signs.isEmpty():
        every = seen.select("item", F.col("parens").alias("has"), F.col("words").alias("there"))
        out = out.unionByName(every.join(signs, _fits(F.col("words"), F.col("there"), F.col("parens"), F.col("kept"), F.col("has"))).select("item", "passage"))
    return out.distinct().select(F.col("item").alias(item), F.col("passage").alias(passage))
