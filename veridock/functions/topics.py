"""Topics that a text names, with their places, and the numbers bound to them. Column expressions.

Terms are a closed list. A term of the lexicon counts as a whole word, a keyword of an exposure where a word begins. A term is
looked for by its pattern only where it stands in the text at all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridock.functions import quantity as q
from veridock.functions.folds import bound, places

# What policies are about, besides the exposures, and how far from a number its topic may stand.
TOPICS = {
    "waiting_period": ["waiting period", "waiting periods", "wait period", "waiting"],
    "deductible": ["deductible", "deductibles"],
    "co_payment": ["co-payment", "copayment", "co-pay", "copay"],
    "sub_limit": ["sub-limit", "sublimit", "sub limit"],
    "room": ["room rent", "room category", "room", "shared accommodation", "accommodation"],
    "sum_insured": ["sum insured", "base sum insured", "si", "bsi", "cover amount", "base cover"],
    "premium": ["premium", "premiums", "price", "pricing"],
    "discount": ["discount", "discounts"],
    "payout_ratio": ["claims payout ratio", "payout ratio", "claim settlement ratio", "settlement ratio"],
    "bonus": ["bonus", "no claim bonus", "ncb"],
    "renewal": ["renewal", "renew", "renewable", "renewability"],
    "network": ["network", "cashless"],
    "age": ["age", "ages", "aged", "entry age"],
    "members": ["member", "members", "individual", "family"],
    "second_opinion": ["second opinion", "second medical opinion", "e-opinion"],
    "tax": ["tax", "tax benefit", "80d"],
}
REACH = 60

Terms = tuple[tuple[str, str, bool], ...]


def terms(exposures: Sequence[tuple[str, str, Sequence[str]]] = ()) -> Terms:
    """The lexicon and the exposures (id, name, keywords) as (topic, term, whole word)."""
    known = [(topic, word, True) for topic, words in TOPICS.items() for word in words]
    return tuple(known + [(key, word.lower(), False) for key, name, keywords in exposures for word in (name, *keywords)])


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)


def _without(text: Column, names: Sequence[str], edges: tuple[str, str], fill: str = " ") -> Column:
    """The text with names filled over, so that places stay."""
    for name in sorted(names, key=len, reverse=True):
        text = F.regexp_replace(text, f"{edges[0]}{_quoted(name)}{edges[1]}", fill * len(name))
    return text


def hits(text: Column, known: Terms, names: tuple[str, ...] = ()) -> Column:
    """(start, end, topic) of every term, in order; give the normal form of evidence, the plain text of a claim. The terms are data
    of one expression, however many there are."""
    rows = [{"topic": topic, "word": word, "pattern": rf"(?<![a-z0-9]){_quoted(word)}" + (r"(?![a-z0-9])" if whole else "")} for topic, word, whole in known]
    listed = F.from_json(F.lit(json.dumps(rows)), "array<struct<topic:string,word:string,pattern:string>>")

    def of_term(lowered: Column) -> Callable[[Column], Column]:
        return lambda term: F.transform(places(lowered, term["pattern"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), term["topic"].alias("topic")))

    def found(lowered: Column) -> Column:
        return F.array_sort(F.flatten(F.transform(F.filter(listed, lambda term: F.contains(lowered, term["word"])), of_term(lowered))))

    lowered = F.lower(F.coalesce(text, F.lit("")))
    return bound(_without(lowered, [n.lower() for n in names], (r"(?<![a-z0-9])", r"(?![a-z0-9+])")), found)


def bindings(text: Column, known: Terms, names: tuple[str, ...] = ()) -> Column:
    """The numbers of claims, each with the topics that stand nearest to it in its sentence, at most ``REACH`` characters off;
    several at the same distance all count."""

    def nearest(n: Column, around: Column) -> Column:
        lowered = around["text"]
        head = F.left(lowered, n["start"])
        low = F.length(head) - F.length(F.regexp_extract(head, r"(?s)((?:(?!;|\. ).)*)$", 1)) - 1
        behind = F.regexp_extract(F.substring(lowered, n["end"] + 1, F.length(lowered)), r"(?s)^((?:(?!;|\. ).)*)", 1)
        high = n["end"] + F.length(behind)
        gaps = F.transform(F.filter(around["hits"], lambda h: (h["start"] >= low - 1) & (h["start"] <= high)), lambda h: F.struct(F.greatest(F.lit(0), h["start"] - n["end"], n["start"] - h["end"]).alias("gap"), h["topic"].alias("topic")))
        return bound(gaps, lambda gs: bound(F.array_min(F.transform(gs, lambda g: g["gap"])), lambda least: F.when(least <= REACH, F.array_sort(F.array_distinct(F.transform(F.filter(gs, lambda g: g["gap"] == least), lambda g: g["topic"])))).otherwise(F.array().cast("array<string>"))))

    def read(t: Column) -> Column:
        numbered = _without(t, [n for n in names if re.search(r"\d", n)], (r"(?i)(?<![A-Za-z0-9])", r"(?![0-9])"), "·")  # no blank: a name between numbers keeps them apart
        around = F.struct(F.lower(t).alias("text"), hits(t, known, names).alias("hits"))
        return bound(around, lambda x: F.transform(q.quantities(numbered, False), lambda n: n.withField("topics", nearest(n, x))))

    return bound(F.coalesce(text, F.lit("")), read)


def distinct(found: Column) -> Column:
    """The topics among places."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda h: h["topic"])))


def specific(found: Column, prefix: str = "EXP-") -> Column:
    """Exposures that are named for themselves: not only strictly inside a longer term of another one. All places count."""
    own = F.filter(found, lambda h: F.startswith(h["topic"], F.lit(prefix)))
    longer = lambda h, o: (o["topic"] != h["topic"]) & (o["start"] <= h["start"]) & (o["end"] >= h["end"]) & (o["end"] - o["start"] > h["end"] - h["start"])
    return F.array_distinct(F.transform(F.filter(own, lambda h: ~F.exists(own, lambda o: longer(h, o))), lambda h: h["topic"]))
