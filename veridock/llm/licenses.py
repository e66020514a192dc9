"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment. Native.

A text becomes its words, lower-cased, each with a blank on either side (`` apache  license ``), so a phrase with its outer
blanks is found at word boundaries only and never shares a blank with its neighbour, and word numbers are blanks counted.
Of ``licrules``, only rules whose keyword stands in the text run their pattern; each detection is an interval of words. In order of
start, longest first, a detection falls if an interval of its own or a better level that came before reaches as far: it is contained.

Everything is an expression over one row: no shuffle, no join, no state beyond a text and what is found in it. Work is linear in
the text and in the detections: arrays grow in blocks (``folded``), as appending to one array copies it each time.

Base phrases are reported by themselves, whatever the rules find: number of places, first and last.

Defined cases: a null text is read as empty, an empty text has no words and score 0; words are runs of what is no ASCII blank,
control or punctuation; repeated rows are scanned alike; an empty table gives an empty result. Letters beyond A-Z are lower-cased too,
which alters no base phrase, as none has a letter that such a letter becomes. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm.common import id_and_text, table
from veridock.llm.licrules import HINT, HINTS, IDENTIFIER, IDENTIFIERS, NAME, NAMES, STRENGTH, TITLE, TITLES

#: Phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: How much a base phrase alone says.
BASE_STRENGTH = 0.5
#: Elements of an array that grow together.
BLOCK = 256

#: (label, level, keyword, pattern), in order; a rule's place in it is its number.
RULES = tuple(
    [(label, IDENTIFIER, "spdx license identifier", f"spdx license identifier {pattern}") for label, pattern in IDENTIFIERS]
    + [(label, level, keyword, pattern) for level, rules in ((TITLE, TITLES), (NAME, NAMES), (HINT, HINTS)) for label, keyword, pattern in rules]
)

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPAN = "array<struct<start:int,end:int,level:int,rule:int,label:string>>"
_RULES = "array<struct<rule:int,level:int,label:string,pattern:string>>"


def wide(words: str) -> str:
    """Words or a pattern for them, in the spacing of the texts."""
    return words.replace(" ", "  ")


def words_of(text: Column) -> Column:
    """The text's words, each between blanks; empty if there is none."""
    inner = F.trim(F.regexp_replace(F.lower(text), _BETWEEN, "  "))
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def count_words(words: Column) -> Column:
    return ((F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))) / 2).cast("int")


def phrase(words: Column, n_words: Column, text: str, label: str) -> Column:
    """Places of a phrase that cannot overlap itself: label, number, first and last start."""
    found, size = F.lit(f" {wide(text)} "), len(text.split())
    n = ((F.length(words) - F.length(F.replace(words, found, F.lit("")))) / F.length(found)).cast("int")
    first = count_words(F.substring_index(words, f" {wide(text)} ", 1))
    last = n_words - count_words(F.substring_index(words, f" {wide(text)} ", -1)) - size
    return F.when(F.contains(words, found), F.struct(F.lit(label).alias("label"), n.alias("n"), first.alias("first"), last.alias("last")))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """An array of what ``emit`` makes of each item and the state before it, but for nulls; ``step`` gives the next state.
    Results are appended within blocks, and blocks to the whole, so that the work is linear for arrays of any likely length."""
    none, nones = F.array().cast(kind), F.array().cast(f"array<{kind}>")

    def one(at: Column, item: Column) -> Column:
        made = emit(at["s"], item)
        return F.struct(step(at["s"], item).alias("s"), _bound(made, lambda m: F.when(m.isNull(), at["out"]).otherwise(F.concat(at["out"], F.array(m)))).alias("out"))

    def block(at: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(at["s"].alias("s"), none.alias("out")), one, lambda end: F.struct(end["s"].alias("s"), F.concat(at["out"], F.array(end["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK)), lambda i: F.slice(xs, i, F.lit(BLOCK)))
        return F.when(F.size(xs) == 0, none).otherwise(F.aggregate(parts, F.struct(start.alias("s"), nones.alias("out")), block, lambda end: F.flatten(end["out"])))

    return _bound(items, whole)


def _candidates(words: Column, rules: Sequence[tuple[str, int, str, str]]) -> Column:
    """The rules whose keyword stands in the text. Keywords are looked for only where their first word is among the text's, which
    one pass over its words decides for all."""
    by: dict[str, list[dict]] = {}
    for number, (label, level, keyword, pattern) in enumerate(rules):
        by.setdefault(keyword, []).append({"rule": number, "level": level, "label": label, "pattern": f" (?:{wide(pattern)}) "})
    groups = [{"word": keyword.split()[0], "keyword": f" {wide(keyword)} ", "rules": own} for keyword, own in by.items()]
    known = F.from_json(F.lit(json.dumps(groups)), "array<struct<word:string,keyword:string,rules:array<struct<rule:int,level:int,label:string,pattern:string>>>>")
    starts = F.array(*[F.lit(w) for w in sorted({g["word"] for g in groups})])

    def fitting(hits: Column) -> Column:
        there = F.filter(known, lambda g: F.array_contains(hits, g["word"]) & F.contains(words, g["keyword"]))
        return F.when(F.size(hits) == 0, F.array().cast(_RULES)).otherwise(F.flatten(F.transform(there, lambda g: g["rules"])))

    return _bound(F.array_intersect(F.split(words, " "), starts), fitting)


def _matches(words: Column, rule: Column) -> Column:
    """Intervals of words that a rule's pattern matches, left to right."""
    gaps, found = F.split(words, rule["pattern"], -1), F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    sizes = F.zip_with(found, gaps, lambda m, g: F.when(m.isNotNull(), F.struct(count_words(g).alias("gap"), count_words(m).alias("size"))))
    step = lambda at, m: at + m["gap"] + m["size"]
    emit = lambda at, m: F.struct((at + m["gap"]).alias("start"), step(at, m).alias("end"), rule["level"].alias("level"), rule["rule"].alias("rule"), rule["label"].alias("label"))
    return folded(F.filter(sizes, lambda s: s.isNotNull()), F.lit(0), step, emit, _SPAN)


def _standing(spans: Column) -> Column:
    """Spans that no span of their own or a better level contains."""
    ordered = F.array_sort(spans, lambda a, b: _compared([(a["start"], b["start"]), (b["end"], a["end"]), (a["level"], b["level"]), (a["rule"], b["rule"])]))
    levels = range(len(STRENGTH))
    reach = lambda at, level: F.element_at(F.array(*[F.greatest(*[at[f"r{k}"] for k in range(i + 1)]) if i else at["r0"] for i in levels]), level + 1)
    step = lambda at, s: F.struct(*[F.when((s["level"] == k) & (s["end"] > at[f"r{k}"]), s["end"]).otherwise(at[f"r{k}"]).alias(f"r{k}") for k in levels])
    return folded(ordered, F.struct(*[F.lit(0).alias(f"r{k}") for k in levels]), step, lambda at, s: F.when(s["end"] > reach(at, s["level"]), s), _SPAN)


def _compared(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.lit(0)
    for a, b in reversed(pairs):
        out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[tuple[str, int, str, str]] = RULES) -> DataFrame:
    """doc_id, n_words, base (label, n, first, last for each base phrase there) and detections (start, end in words, level, rule,
    label) in order of start."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    words, n_words = F.col("words"), F.col("n_words")
    rows = rows.select("doc_id", "words", count_words(words).alias("n_words"), _candidates(words, rules).alias("rules"))
    base = F.filter(F.array(*[phrase(words, n_words, text, label) for text, label in BASE]), lambda b: b.isNotNull())
    found = F.when(F.size("rules") == 0, F.array().cast(_SPAN)).otherwise(_standing(F.flatten(F.transform("rules", lambda r: _matches(words, r)))))
    return rows.select("doc_id", n_words.cast("long").alias("n_words"), base.alias("base"), found.alias("detections"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base, found = F.col("base"), F.col("detections")
    labels = lambda xs: F.transform(xs, lambda x: x["label"])
    sorted_text = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    strength = F.array(*[F.lit(s) for s in STRENGTH])
    best = F.when(F.size(found) > 0, F.element_at(strength, F.array_min(F.transform(found, lambda s: s["level"])) + 1)).otherwise(0.0)
    return out.select(
        "doc_id",
        "n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda total, b: total + b["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["last"])).cast("long").alias("last_word"),
        sorted_text(labels(base)).alias("base_labels"),
        sorted_text(F.concat(labels(base), labels(found))).alias("labels"),
        F.greatest(best, F.when(F.size(base) > 0, BASE_STRENGTH).otherwise(0.0)).alias("score"),
    )


QUERIES = {"op11_license_scan": op11_license_scan}
SQL: dict[str, str] = {}
