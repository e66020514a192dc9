"""Audit of statements: where each is judged, the checks on a reviewer's verdict, and the checks that need none.

A statement's status only gets worse: every check that fails caps it (``rules.capped``). Each audit is one pass of joins on
ids and expressions over arrays; nothing is compared across statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions import markers as m
from veridock.functions import predicates as p
from veridock.functions import quantity as q
from veridock.functions import textnorm as t
from veridock.functions import topics as tp
from veridock.operators import rules as r
from veridock.session import stored

# Fixed values.
NOT_STATED_TEXT = "Not stated in the brochure"
ADDON_TEXT, OPTIONAL_TEXT = "Available as an add-on at extra premium", "Optional benefit at extra premium"
GOOD = ("VERIFIED", "VERIFIED_WITH_QUALIFIER")
STRINGS = "array<string>"


def _array(column: Column | str, kind: str = STRINGS) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.array().cast(kind))


def _failed(checks: dict[str, tuple[Column, Column | str]]) -> Column:
    """The checks that fail, in order, with what they cap at."""
    rows = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("check"), (F.lit(s) if isinstance(s, str) else s).alias("capped_at"))) for n, (c, s) in checks.items()]
    return F.array_compact(F.array(*rows))


def _settled(status: Column, failed: Column, qualifier: Column | None = None) -> Column:
    out = r.capped(status, F.transform(failed, lambda x: x["capped_at"]))
    return out if qualifier is None else r.with_qualifier(out, F.coalesce(qualifier, F.lit("")))


def read_evidence(evidence: DataFrame, known: tp.Terms, names: tuple[str, ...] = ()) -> DataFrame:
    """Evidence with what the checks read from it: ``unmarked`` (text without its footnote markers), ``stated`` (its numbers and
    those of its labels, each with the topics of where it stands) and ``topics`` (of its heading, labels and text).
    ``evidence``: evidence_id, document_id, citable, item_type, section, row_label, column_label, text, tier, variant,
    si_condition, markers, linked."""
    label = lambda c: F.coalesce(c, F.lit(""))
    e = stored(evidence.withColumn("unmarked", m.masked(F.col("text"), m.spans(F.col("text"), _array("markers"), F.col("item_type") == "FOOTNOTE"))))
    e = e.withColumn("context", F.concat_ws(" ", "section", label(F.col("row_label")), label(F.col("column_label")), "text"))
    e = stored(e.withColumn("topics", tp.distinct(tp.hits(t.normalised("context"), known, names))))
    header = F.coalesce(q.header_unit(F.col("row_label")), q.header_unit(F.col("column_label")))
    e = stored(e.withColumn("header", header).withColumn("own", q.quantities(F.col("unmarked"), True, F.col("header.unit"), F.col("header.scale"))))
    segments = q.label_segments(F.col("row_label"), F.col("column_label"), F.col("text"))
    parts = stored(e.select("evidence_id", F.explode(segments).alias("segment")).withColumn("n", q.quantities(F.col("segment"))).withColumn("t", tp.distinct(tp.hits(t.normalised("segment"), known, names))))
    stated = lambda n, topics, labelled: F.transform(n, lambda x: F.struct(x["value"].alias("value"), x["unit"].alias("unit"), x["raw"].alias("raw"), topics.alias("topics"), F.lit(labelled).alias("label")))
    labels = parts.groupBy("evidence_id").agg(F.flatten(F.collect_list(stated(F.col("n"), F.col("t"), True))).alias("by_label"))
    e = e.join(labels, "evidence_id", "left").withColumn("by_text", stated(F.col("own"), F.col("topics"), False))
    return e.withColumn("stated", F.when(F.col("by_label").isNull(), F.col("by_text")).otherwise(F.concat("by_text", "by_label"))).drop("context", "header", "own", "by_label", "by_text")


def with_referrers(evidence: DataFrame) -> DataFrame:
    """Read evidence whose footnotes have the topics of the items that link to them too."""
    links = evidence.select(F.explode("linked").alias("evidence_id"), "topics").groupBy("evidence_id").agg(F.array_distinct(F.flatten(F.collect_list("topics"))).alias("more"))
    e = evidence.join(links, "evidence_id", "left")
    return e.withColumn("topics", F.when(F.col("item_type") == "FOOTNOTE", F.array_union("topics", _array("more"))).otherwise(F.col("topics"))).drop("more")


def number_status(claimed: Column, stated: Column, topics: Column) -> Column:
    """The number check against what evidence states; a label's number counts only if the label shares a topic with the
    claim, or the claim has none."""
    return q.number_check(claimed, F.filter(stated, lambda s: ~s["label"] | (F.size(topics) == 0) | F.arrays_overlap(s["topics"], topics)))


def unbound(claimed: Column, stated: Column) -> Column:
    """Numbers of a claim that evidence states, but never where the topic next to them is named."""
    def loose(c: Column) -> Column:
        same = F.filter(stated, lambda s: q.equal(c, s))
        return (F.size(c["topics"]) > 0) & (F.size(same) > 0) & ~F.exists(same, lambda s: F.arrays_overlap(s["topics"], c["topics"]))

    return F.transform(F.filter(claimed, loose), lambda c: c["raw"])


def range_text(x: Column) -> Column:
    """A range of the sum insured as text."""
    money = lambda c: F.concat(F.lit("₹"), q.grouped_indian(c))
    return (
        F.when(x["low"] == x["high"], money(x["low"]))
        .when(x["high"] == float("inf"), F.concat(F.when(x["low_ex"], "above ").otherwise("from "), money(x["low"])))
        .when(x["low"] == 0, F.concat(F.when(x["high_ex"], "below ").otherwise("up to "), money(x["high"])))
        .otherwise(F.concat(money(x["low"]), F.lit(" to "), money(x["high"])))
    )


def structured_qualifiers(scope: Column, scope_topics: Column, variants: Column, all_variants: Column, tiers: Column, conditions: Column, ranges: Column) -> Column:
    """What the supporting items say of variant, tier and sum insured and the claim's row does not. ``variants``, ``tiers``
    and ``conditions`` are those of the items, ``ranges`` what the conditions state."""
    canonical = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda v: F.replace(t.normalised(v), F.lit(" "), F.lit("")))))
    said = F.replace(t.normalised(scope), F.lit(" "), F.lit(""))
    named = F.exists(canonical(variants), lambda v: F.contains(said, v))
    some = (F.size(variants) > 0) & (canonical(variants) != canonical(all_variants)) & ~named
    addon = F.arrays_overlap(tiers, F.array(F.lit("ADDON"), F.lit("OPTIONAL"))) & ~scope.rlike(p.ADDON)
    shown = F.array_distinct(F.transform(ranges, range_text))
    limits = F.when(F.size(shown) == 1, F.concat(F.lit("Applies for sum insured "), shown[0])).when(F.size(shown) > 1, F.concat(F.lit("Limit depends on the sum insured ("), F.array_join(shown, "; "), F.lit(")"))).otherwise(F.concat(F.lit("Applies for "), t.rupees_shown(F.get(conditions, F.lit(0)))))
    return F.array_compact(F.array(
        F.when(some, F.concat(F.lit("Applies to "), F.array_join(F.array_sort(F.array_distinct(variants)), " / "), F.lit(" only"))),
        F.when(addon, F.when(F.array_contains(tiers, "ADDON"), ADDON_TEXT).otherwise(OPTIONAL_TEXT)),
        F.when((F.size(conditions) > 0) & ~F.array_contains(scope_topics, "sum_insured"), limits),
    ))


def cells_of(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """(claim_id, exposure_id, match_id, status, evidenced): the cell that a claim's row is, else those of the exposures it
    names; an exposure without a cell comes without one. ``claims``: claim_id, policy_id, match_id, exposures."""
    own = claims.join(cells, ["policy_id", "match_id"]).select("claim_id", "exposure_id", "match_id", "status", "evidenced")
    rest = claims.join(own.select("claim_id"), "claim_id", "left_anti").select("claim_id", "policy_id", F.explode("exposures").alias("exposure_id"))
    return own.unionByName(rest.join(cells, ["policy_id", "exposure_id"], "left").select("claim_id", "exposure_id", "match_id", "status", "evidenced"))


def absence_checks(found: DataFrame) -> DataFrame:
    """Of each claim with cells: whether one is there, and the worst that a cell caps a claim of absence at; what it caps a
    claim that the brochure is silent at; and whether an add-on covers it after all. ``found``: as ``cells_of`` returns."""
    there = F.col("match_id").isNotNull()
    excluded = (F.col("status") == "EXCLUDED") & F.col("evidenced")
    addon = (F.col("status") == "COVERED_VIA_ADDON") & F.col("evidenced")
    cap = F.when(excluded | addon, "VERIFIED").when(F.col("status") == "NOT_STATED", "UNSUPPORTED").otherwise("CONTRADICTED")
    return found.groupBy("claim_id").agg(
        F.bool_or(there).alias("has_cell"), F.array_compact(F.collect_set(F.when(there, cap))).alias("absence_caps"),
        F.bool_or(there & (F.col("status") != "NOT_STATED")).alias("is_stated"), F.bool_or(there & addon).alias("via_addon"),
    )


def not_stated_verdicts(claims: DataFrame, cells: DataFrame, aliases: dict[str, list[str]], known: tp.Terms) -> DataFrame:
    """Claims that a brochure does not state something: every cell they speak of must be silent. ``claims``: claim_id,
    policy_id, text, match_id, contrary (the reviewer quotes evidence that states it)."""
    named = tuple(a for v in aliases.values() for a in v)
    c = stored(claims.withColumn("places", tp.hits(t.normalised("text"), known, named)).withColumn("exposures", tp.specific(F.col("places"))))
    d = c.join(absence_checks(cells_of(c, cells)), "claim_id", "left")
    other = F.size(F.array_remove(t.names(aliases, t.normalised("text")), F.col("policy_id"))) > 0
    has, stated = F.coalesce("has_cell", F.lit(False)), F.coalesce("is_stated", F.lit(False))
    failed = _failed({
        "absence": (~has | stated | (F.col("contrary") & ~stated), F.when(has & stated, "CONTRADICTED").otherwise("NEEDS_REVIEW")),
        "policy_name": (other & ~stated, "UNSUPPORTED"),
    })
    return d.select("claim_id", _settled(F.lit("VERIFIED"), failed).alias("status"), failed.alias("failed"))


def with_quoted(said: DataFrame) -> DataFrame:
    """Quotes (quote, shown, unmarked, section) with whether their item has them, as ``textnorm.quoted_in_item`` says; every
    normal form is a column, and so taken once."""
    forms = said.withColumns({
        "_plain": t.normalised("quote"), "_kept": t.normalised("quote", keep_paren=True), "_t": t.normalised("shown"), "_u": t.normalised("unmarked"), "_b": t.normalised(F.concat_ws(" ", "section", "shown")),
        "_goes_on": F.col("shown").rlike(r"^\p{Ll}") & ~F.coalesce("section", F.lit("")).isin(*t.APART),
    })
    missing = lambda c: F.exists(F.regexp_extract_all("quote", F.lit(r"(\(\d{1,2}\))")), lambda m: ~F.contains(F.col(c), m))
    wanted = lambda c: F.when(missing(c), F.col("_kept")).otherwise(F.col("_plain"))
    stands = t.bounded_in(wanted("shown"), "_t") | t.bounded_in(wanted("unmarked"), "_u") | (F.col("_goes_on") & t.bounded_in(wanted("shown"), "_b"))
    return forms.withColumn("stands", stands).drop("_plain", "_kept", "_t", "_u", "_b", "_goes_on")


def policy_verdicts(claims: DataFrame, verdicts: DataFrame, evidence: DataFrame, aliases: dict[str, list[str]], cells: DataFrame | None = None, policies: DataFrame | None = None, known: tp.Terms = (), names: tuple[str, ...] = ()) -> DataFrame:
    """Audit of statements about a policy: claim_id, status, llm_status, number_check, qualifier, failed.

    ``claims``: claim_id, policy_id, text and, if there, scope (the text with the other cell of its row), claim_type, match_id;
    ``verdicts``: claim_id, status, supporting_evidence_ids, quotes (array of struct<evidence_id, quote>),
    required_qualifier; ``evidence``: as ``read_evidence`` returns it; ``cells``: policy_id, match_id, exposure_id, status,
    evidenced; ``policies``: policy_id, variants. Checks, in order: ownership, quotes, numbers, policy_name, topic_anchor,
    absolute, qualifier, absence, pricing. A statement without a verdict needs review."""
    text, policy = F.col("text"), F.col("policy_id")
    extra = {"scope": text, "claim_type": F.lit(None).cast("string"), "match_id": F.lit(None).cast("string")}
    c = claims.select("claim_id", "policy_id", "text", *[F.coalesce(k, v).alias(k) if k in claims.columns else v.alias(k) for k, v in extra.items()])
    all_names = (*names, *(a for v in aliases.values() for a in v))
    c = stored(c.withColumn("claimed", tp.bindings(text, known, all_names)).withColumn("places", tp.hits(t.normalised("text"), known, all_names)).withColumn("scope_topics", tp.distinct(tp.hits(t.normalised("scope"), known, all_names))))
    c = c.withColumn("topics", tp.distinct(F.col("places"))).withColumn("exposures", tp.specific(F.col("places")))
    v = stored(c.join(verdicts, "claim_id", "left").withColumn("qualified", q.quantities(F.coalesce("required_qualifier", F.lit("")))))

    shown = evidence.select("evidence_id", "document_id", "citable", F.col("text").alias("shown"), "unmarked", "section", "stated", F.col("topics").alias("item_topics"), "tier", "variant", "si_condition", "linked")
    cited = v.select("claim_id", "policy_id", F.posexplode(F.array_distinct("supporting_evidence_ids")).alias("place", "evidence_id")).join(shown, "evidence_id", "left")
    own = F.coalesce((F.col("document_id") == policy) & F.col("citable"), F.lit(False))
    foreign = F.coalesce(F.col("document_id") != policy, F.lit(False))
    good = cited.where(own)
    notes = good.select("claim_id", F.explode("linked").alias("evidence_id")).distinct().join(shown.select("evidence_id", F.col("shown").alias("note"), F.col("stated").alias("note_stated")), "evidence_id")
    notes = notes.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", "note"))), lambda x: x["note"]).alias("notes"), F.flatten(F.collect_list("note_stated")).alias("note_stated"))
    listed = lambda c: F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(c).alias("x")))), lambda s: s["x"]))
    by_item = good.groupBy("claim_id").agg(
        F.count("*").alias("n_own"), F.flatten(F.collect_list("stated")).alias("stated"), F.array_distinct(F.flatten(F.collect_list("item_topics"))).alias("item_topics"), listed("shown").alias("bodies"),
        listed("variant").alias("item_variants"), listed("tier").alias("tiers"), listed("si_condition").alias("conditions"),
    )
    strangers = cited.groupBy("claim_id").agg(F.bool_or(foreign).alias("foreign"))
    said = v.select("claim_id", "policy_id", F.explode("quotes").alias("x")).select("claim_id", "policy_id", "x.evidence_id", "x.quote")
    said = said.join(good.select("claim_id", "evidence_id", "shown", "unmarked", "section"), ["claim_id", "evidence_id"], "left")
    by_quote = with_quoted(said).groupBy("claim_id").agg(F.bool_and(F.col("shown").isNotNull() & F.coalesce("stands", F.lit(False))).alias("quoted"))

    d = v.join(by_item, "claim_id", "left").join(strangers, "claim_id", "left").join(by_quote, "claim_id", "left").join(notes, "claim_id", "left")
    kind = evidence.schema["stated"].dataType.simpleString()
    d = d.select(*[x for x in d.columns if x not in ("stated", "note_stated", "bodies", "notes", "item_variants", "tiers", "conditions", "item_topics")],
                 *[_array(x, kind).alias(x) for x in ("stated", "note_stated")], *[_array(x).alias(x) for x in ("bodies", "notes", "item_variants", "tiers", "conditions", "item_topics")])
    d = stored(d.withColumn("n_own", F.coalesce("n_own", F.lit(0))).withColumn("ranges", q.sum_insured_ranges(F.array_join("conditions", " ; "))))
    if policies is not None:
        d = d.join(policies.select("policy_id", F.col("variants").alias("all_variants")), "policy_id", "left")
    d = d.withColumn("all_variants", _array("all_variants")) if policies is not None else d.withColumn("all_variants", F.col("item_variants"))
    if cells is not None:
        d = d.join(absence_checks(cells_of(c, cells)), "claim_id", "left")
    has_cell, caps, via = (F.coalesce("has_cell", F.lit(False)), _array("absence_caps"), F.coalesce("via_addon", F.lit(False))) if cells is not None else (F.lit(False), F.array().cast(STRINGS), F.lit(False))

    corpus = F.concat("bodies", "notes")
    wanted = F.trim(F.coalesce("required_qualifier", F.lit("")))
    d = d.withColumns({
        "check": number_status(F.col("claimed"), F.col("stated"), F.col("topics")), "named": t.names(aliases, t.normalised(text)), "corpus": t.normalised(F.array_join(corpus, " ")),
        "hedges": F.filter(corpus, lambda x: x.rlike(p.HEDGE)), "wanted": wanted, "misstated": (wanted != "") & (F.size(q.unstated(F.col("qualified"), F.concat("stated", "note_stated"))) > 0),
        "of_notes": F.when(wanted == "", F.array_compact(F.transform("notes", lambda n: p.missing_restriction(n, text, F.col("scope"))))).otherwise(F.array().cast(STRINGS)),
        "loose": F.size(unbound(F.col("claimed"), F.col("stated"))) > 0, "worst": F.array_max(F.transform(caps, r.severity)), "absent": p.says_absence(text) & ~p.says_not_stated(text),
    })
    d = d.withColumn("absolute", p.overstatements(text, F.col("corpus")))
    d = d.withColumn("hedge", F.when((F.size("absolute") > 0) & (F.size("hedges") > 0), p.best_sentence(F.get(F.col("hedges"), F.lit(0)), text)))
    supported, check, absent, misstated = F.col("status").isin(*GOOD), F.col("check"), F.col("absent"), F.col("misstated")
    others, worst, given = F.array_remove("named", policy), F.col("worst"), F.col("wanted") != ""
    parts = F.concat(
        F.array_compact(F.array("hedge")),
        structured_qualifiers(F.col("scope"), F.col("scope_topics"), F.col("item_variants"), F.col("all_variants"), F.col("tiers"), F.col("conditions"), F.col("ranges")),
        F.when(given & ~misstated, F.array("wanted")).otherwise(F.col("of_notes")),
        F.array_compact(F.array(F.when(absent & via & ~text.rlike(p.ADDON), ADDON_TEXT))),
    )
    qualifier = F.array_join(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(t.rupees_shown(x))), lambda x: x != "")), "; ")
    money = F.exists("claimed", lambda n: n["unit"] == "INR")
    priced = F.coalesce(F.col("claim_type") == "POLICY_PRICING", F.lit(False)) | (text.rlike(p.PRICE_WORD) & money)
    compared = (F.size("named") >= 2) | text.rlike(p.COMPARISON)
    explained = p.priced_in_context(text) | (given & ~misstated & p.priced_in_context(F.concat_ws(" ", text, "wanted")))
    apart = ~F.arrays_overlap("topics", "item_topics")
    failed = _failed({
        "ownership": (F.coalesce("foreign", F.lit(False)) | (supported & (F.col("n_own") == 0)), "UNSUPPORTED"),
        "quotes": (supported & (F.col("n_own") > 0) & ~F.coalesce("quoted", F.lit(False)), "NEEDS_REVIEW"),
        "numbers": (check.isin("FAIL_CONTRADICTED", "FAIL_MISSING"), F.when(check == "FAIL_CONTRADICTED", "CONTRADICTED").otherwise("UNSUPPORTED")),
        "policy_name": (F.size(others) > 0, "UNSUPPORTED"),
        "topic_anchor": ((F.size("topics") > 0) & (F.col("n_own") > 0) & (apart | F.col("loose")), "UNSUPPORTED"),
        "absolute": (F.size("absolute") > 0, "NEEDS_REVIEW"),
        "qualifier": (misstated, "NEEDS_REVIEW"),
        "absence": (absent & (~has_cell | (worst > 0)) if cells is not None else F.lit(False), F.when(~has_cell, "NEEDS_REVIEW").otherwise(F.element_at(F.array(*[F.lit(s) for s in r.SEVERITY]), worst + 1))),
        "pricing": (priced & (compared | ~explained), F.when(compared, "UNSUPPORTED").otherwise("NEEDS_REVIEW")),
    })
    d = d.withColumn("failed", failed).withColumn("qualifier", F.when(F.col("status").isNull(), F.lit("")).otherwise(qualifier))
    status = _settled(F.coalesce("status", F.lit("NEEDS_REVIEW")), F.col("failed"), F.col("qualifier"))
    return d.select("claim_id", status.alias("status"), F.col("status").alias("llm_status"), check.alias("number_check"), "qualifier", "failed")


def record_verdicts(claims: DataFrame, verdicts: DataFrame, records: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Audit of statements about the adviser's own capabilities: only its records count, no product may be named, and words that
    a record says to keep must be there. ``records``: evidence_id, text, required (words to keep)."""
    c = stored(claims.withColumn("claimed", q.quantities(F.col("text"), False)).join(verdicts, "claim_id", "left"))
    shown = stored(records.select("evidence_id", F.col("text").alias("shown"), "required", q.quantities(F.col("text")).alias("stated")))
    cited = c.select("claim_id", F.explode(F.array_distinct("supporting_evidence_ids")).alias("evidence_id")).join(shown, "evidence_id", "left")
    known = F.col("shown").isNotNull()
    by_item = cited.groupBy("claim_id").agg(F.bool_or(~known).alias("foreign"), F.count_if(known).alias("n_own"), F.flatten(F.collect_list("stated")).alias("stated"), F.concat_ws(" ", F.array_sort(F.collect_list("shown"))).alias("body"), F.array_distinct(F.flatten(F.collect_list("required"))).alias("required"))
    said = c.select("claim_id", F.explode("quotes").alias("x")).select("claim_id", "x.evidence_id", "x.quote").join(shown, "evidence_id", "left")
    by_quote = said.groupBy("claim_id").agg(F.bool_and(F.coalesce(t.quoted_in("quote", F.coalesce("shown", F.lit(""))), F.lit(False))).alias("quoted"))
    d = c.join(by_item, "claim_id", "left").join(by_quote, "claim_id", "left").withColumn("stated", _array("stated", q.QUANTITY)).withColumn("required", _array("required"))
    n, supported = F.coalesce("n_own", F.lit(0)), F.col("status").isin(*GOOD)
    check = q.number_check(F.col("claimed"), F.col("stated"))
    dropped = F.filter("required", lambda w: ~F.regexp_like(F.lower("text"), F.concat(F.lit(r"\b\Q"), F.lower(w), F.lit(r"\E\b"))))
    failed = _failed({
        "ownership": (F.coalesce("foreign", F.lit(False)) | (supported & (n == 0)), "UNSUPPORTED"),
        "quotes": (supported & (n > 0) & ~F.coalesce("quoted", F.lit(False)), "NEEDS_REVIEW"),
        "numbers": (check.isin("FAIL_CONTRADICTED", "FAIL_MISSING"), F.when(check == "FAIL_CONTRADICTED", "CONTRADICTED").otherwise("UNSUPPORTED")),
        "policy_name": (F.size(t.names(aliases, t.normalised("text"))) > 0, "UNSUPPORTED"),
        "absolute": (F.size(p.overstatements(F.col("text"), t.normalised(F.coalesce("body", F.lit(""))))) > 0, "NEEDS_REVIEW"),
        "condition": (F.size(dropped) > 0, "NEEDS_REVIEW"),
    })
    return d.select("claim_id", _settled(F.coalesce("status", F.lit("NEEDS_REVIEW")), failed).alias("status"), check.alias("number_check"), failed.alias("failed"))


def web_problems(facts: DataFrame, pages: DataFrame, least_words: int = 4) -> DataFrame:
    """Why facts cannot count as web-sourced: (run_id, fact_id, problems), an empty array if they can. ``facts``: run_id,
    fact_id, value, source_ids, quotes (array), company; ``pages``: run_id, source_id, content. Every cited source must
    exist, every quote have four words and stand in one of them, every number of the value be in the quotes (a lower bound
    may be lower than what they give), and every name of the value but the company's own."""
    key = ["run_id", "fact_id"]
    cited = facts.select(*key, F.explode(F.array_distinct("source_ids")).alias("source_id")).join(pages, ["run_id", "source_id"], "left")
    unknown = cited.groupBy(*key).agg(F.bool_or(F.col("content").isNull()).alias("unknown"))
    said = facts.select(*key, F.explode("quotes").alias("quote")).withColumn("short", F.size(F.split(F.trim("quote"), r"\s+")) < least_words)
    hits = said.join(cited.where("content is not null"), key, "left").groupBy(*key, "quote").agg(F.bool_or(F.coalesce(t.quoted_in("quote", F.coalesce("content", F.lit(""))), F.lit(False))).alias("found"), F.first("short").alias("short"))
    quotes = hits.groupBy(*key).agg(F.bool_or("short").alias("short"), F.bool_or(~F.col("short") & ~F.col("found")).alias("missing"))
    d = stored(facts.withColumn("claimed", q.quantities(F.col("value"), False)).withColumn("given", q.quantities(F.array_join("quotes", " \n "), False))).join(unknown, key, "left").join(quotes, key, "left")
    bound = lambda c: F.regexp_like(F.substring(F.col("value"), F.lit(1), c["start"]), F.lit(r"(?i)(?:over|more than|above|at least)\s*$")) | F.endswith(c["raw"], F.lit("+")) | F.regexp_like(F.substring(F.col("value"), c["end"] + 1, F.lit(3)), F.lit(r"^\s*\+"))
    stated = lambda c: F.exists("given", lambda g: q.equal(c, g)) | (bound(c) & q.at_least(c, F.col("given")))
    stem = lambda w: F.left(F.regexp_replace(F.replace(F.lower(w), F.lit("’"), F.lit("'")), r"^['-]+|['-]+$", ""), F.lit(t.STEM))
    every = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"({t.WORD})")), stem)
    known = F.concat(every(F.array_join("quotes", " ")), every(F.coalesce("company", F.lit(""))))
    unnamed = F.filter(t.proper_names("value"), lambda w: ~F.array_contains(known, stem(w)))
    problems = F.array_compact(F.array(
        F.when(F.coalesce("unknown", F.lit(False)), "unknown source"),
        F.when(F.size("source_ids") == 0, "no source cited"),
        F.when(F.size("quotes") == 0, "no quote given"),
        F.when(F.coalesce("short", F.lit(False)), "quote too short"),
        F.when(F.coalesce("missing", F.lit(False)), "quote not in its sources"),
        F.when(F.exists("claimed", lambda c: ~stated(c)), "number not in the quotes"),
        F.when((F.size("quotes") > 0) & (F.size(unnamed) > 0), "name not in the quotes"),
    ))
    return d.select(*key, problems.alias("problems"))


def resolved_facts(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts with the status that the checks leave them: web-sourced ones with a problem are model knowledge, or an assumption
    if the company is not recognised, as then is everything else; money figures, and exact head counts that are not
    web-sourced, are assumptions. ``facts``: as above with field, status, recognised."""
    d = facts.join(web_problems(facts, pages), ["run_id", "fact_id"])
    web = (F.col("status") == "WEB_SOURCED") & (F.size("problems") == 0)
    kept = F.when(web, "WEB_SOURCED").when(~F.col("recognised"), "ASSUMPTION").when(F.col("status") == "WEB_SOURCED", "MODEL_KNOWLEDGE").otherwise(F.col("status"))
    figure = F.when(kept == "WEB_SOURCED", p.states_money(F.col("value"))).otherwise(p.states_figure(F.col("field"), F.col("value")))
    return d.select(*[c for c in facts.columns if c != "status"], F.when(figure, "ASSUMPTION").otherwise(kept).alias("status"), F.when(F.col("status") == "WEB_SOURCED", F.col("problems")).otherwise(F.array().cast(STRINGS)).alias("problems"))


def company_verdicts(claims: DataFrame, facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Audit of statements about the company against its profile's facts. ``claims``: run_id, claim_id, slide, text,
    basis_fact_ids, web (it is labelled web-sourced); ``facts``: run_id, fact_id, field, value, status, problems;
    ``runs``: run_id, company, has_profile."""
    key = ["run_id", "claim_id"]
    basis = claims.select(*key, F.explode(F.array_distinct("basis_fact_ids")).alias("fact_id")).join(facts.select("run_id", "fact_id", "field", "value", "status", "problems"), ["run_id", "fact_id"], "left")
    by = basis.groupBy(*key).agg(
        F.count_if(F.col("value").isNull()).alias("unknown"), F.count("*").alias("n"), F.array_compact(F.array_sort(F.collect_list("value"))).alias("values"), F.bool_or(F.col("field") == "business_risk").alias("risk"),
        F.bool_and((F.col("status") == "WEB_SOURCED") & (F.size("problems") == 0)).alias("checked"),
    )
    d = claims.join(by, key, "left").join(runs, "run_id", "left").withColumn("values", _array("values"))
    d = stored(d.withColumn("claimed", q.quantities(F.col("text"), False)).withColumn("given", q.quantities(F.array_join("values", " \n "), False)))
    numbers = q.number_check(F.col("claimed"), F.col("given"))
    extra = F.array_except(t.stems("text", F.coalesce("company", F.lit(""))), F.flatten(F.transform("values", t.stems)))
    profile, mapped = F.coalesce("has_profile", F.lit(False)), (F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("unknown", F.lit(0)) == 0)
    marked = F.endswith(F.rtrim("text"), F.lit("*"))
    live = profile & mapped
    failed = _failed({
        "company": (~profile | ~mapped | ((F.col("slide") != 1) & F.coalesce("risk", F.lit(False))), F.when(~profile, "NEEDS_REVIEW").when(~mapped, "UNSUPPORTED").otherwise("NEEDS_REVIEW")),
        "wording": (live & (F.col("slide") == 1) & (F.size(extra) > 0), "NEEDS_REVIEW"),
        "numbers": (live & numbers.isin("FAIL_CONTRADICTED", "FAIL_MISSING"), F.when(numbers == "FAIL_CONTRADICTED", "CONTRADICTED").otherwise("UNSUPPORTED")),
        "precise_figure": (live & ~F.col("web") & (F.size(t.precise_figures("text")) > 0), "NEEDS_REVIEW"),
        "web_source": (live & F.col("web") & ~F.coalesce("checked", F.lit(False)), "NEEDS_REVIEW"),
        "label": (live & ~F.col("web") & ~marked, "NEEDS_REVIEW"),
    })
    status = _settled(F.lit("VERIFIED"), failed)
    return d.select(*key, F.when((status == "VERIFIED") & ~F.col("web"), "LABELLED_ASSUMPTION").otherwise(status).alias("status"), failed.alias("failed"))


def link_verdicts(claims: DataFrame, facts: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Lines that say why something matters to the client: their facts must exist, their numbers be those facts', and no product
    be named. ``claims``: run_id, claim_id, text, basis_fact_ids."""
    key = ["run_id", "claim_id"]
    basis = claims.select(*key, F.explode("basis_fact_ids").alias("fact_id")).join(facts.select("run_id", "fact_id", "value"), ["run_id", "fact_id"], "left")
    by = basis.groupBy(*key).agg(F.bool_and(F.col("value").isNotNull()).alias("all_known"), F.array_compact(F.array_sort(F.collect_list("value"))).alias("values"))
    d = stored(claims.join(by, key, "left").withColumn("claimed", q.quantities(F.col("text"), False)).withColumn("given", q.quantities(F.array_join(_array("values"), " \n "), False)))
    other = q.number_check(F.col("claimed"), F.col("given")).isin("FAIL_CONTRADICTED", "FAIL_MISSING") | (F.size(t.names(aliases, t.normalised("text"))) > 0)
    return d.select(*key, F.when(~F.coalesce("all_known", F.lit(False)) | other, "NEEDS_REVIEW").otherwise("NON_FACTUAL").alias("status"))


def assumption_status(text: Column, amounts: Column, sum_insured: Column) -> Column:
    """An assumption of the run: it carries its mark, and an amount beside the words "sum insured" is the run's."""
    off = F.contains(F.lower(text), F.lit("sum insured")) & (sum_insured > 0) & F.exists(amounts, lambda n: (n["unit"] == "INR") & (F.abs(n["value"] - sum_insured) > 0.5))
    return F.when(~F.endswith(F.rtrim(text), F.lit("*")) | F.coalesce(off, F.lit(False)), "NEEDS_REVIEW").otherwise("LABELLED_ASSUMPTION")


def routed(claims: DataFrame, policies: DataFrame, aliases: dict[str, list[str]], names: tuple[str, ...] = ()) -> DataFrame:
    """Where each statement is judged: claim_id, route, policy_id, status. The route is ``code`` (with its status), ``records``,
    ``link``, ``company``, ``assumption``, ``not_stated`` or ``policy``; a product is inferred if exactly one is named.
    ``claims``: claim_id, slide, claim_type, policy_id, match_id, text, n_basis; ``policies``: policy_id."""
    products = "|".join(f"\\Q{n}\\E" for n in names)
    plain = F.regexp_replace("text", f"(?i){products}", " ") if names else F.col("text")
    d = stored(claims.withColumn("numbered", F.size(q.quantities(plain, False)) > 0).withColumn("named", t.names(aliases, t.normalised("text"))))
    d = d.withColumn("about", F.coalesce("policy_id", F.when(F.size("named") == 1, F.col("named")[0])))
    d = d.join(policies.select(F.col("policy_id").alias("about"), F.lit(True).alias("audited")), "about", "left").withColumn("audited", F.coalesce("audited", F.lit(False)))
    kind, slide = F.col("claim_type"), F.col("slide")
    plainly = (kind == "NON_FACTUAL") & (F.col("n_basis") == 0)
    states = F.col("numbered") | (F.size("named") > 0)
    code = F.when((slide == 2) & ~kind.isin("CAPABILITY_STATEMENT", "NON_FACTUAL"), "UNSUPPORTED").when(kind == "CAPABILITY_STATEMENT", None).when((kind == "NON_FACTUAL") & (F.col("n_basis") > 0), None)
    code = code.when(plainly & ~states, "NON_FACTUAL").when(plainly & ((slide == 2) | ~F.col("audited")), "NEEDS_REVIEW")
    company = (kind == "COMPANY_FACT") | ((kind == "ASSUMPTION") & (F.col("n_basis") > 0))
    code = code.when(~plainly & ~company & (kind != "ASSUMPTION") & ~F.col("audited"), "UNSUPPORTED")
    row = (F.col("text") == NOT_STATED_TEXT) & F.col("match_id").isNotNull()
    route = F.when(kind == "CAPABILITY_STATEMENT", "records").when((kind == "NON_FACTUAL") & (F.col("n_basis") > 0), "link").when(company, "company").when(kind == "ASSUMPTION", "assumption").when(row | p.says_not_stated(F.col("text")), "not_stated").otherwise("policy")
    return d.select("claim_id", F.when(code.isNotNull(), "code").otherwise(route).alias("route"), F.when(code.isNull() & route.isin("policy", "not_stated"), F.col("about")).alias("policy_id"), code.alias("status"))


def claim_gate_rules(attested: Column | None = None) -> list[tuple[str, str, Column]]:
    """(item, kind, condition) of the gate's rules for statements, over claim_id, state, status, material, failed (names of
    failed checks), number_failed, qualifier_shown, n_repairs. Removed statements do not count."""
    live = F.coalesce(F.col("state") != "REMOVED", F.lit(False))
    status = F.col("status")
    vouched = status == "ADVISOR_ATTESTED" if attested is None else attested
    has = lambda name: F.array_contains("failed", name)
    hidden = (status == "VERIFIED_WITH_QUALIFIER") & ~F.col("qualifier_shown")
    return [
        ("CONTRADICTED", "fail", live & (status == "CONTRADICTED")),
        ("UNSUPPORTED", "fail", live & (status == "UNSUPPORTED") & F.col("material")),
        ("UNSUPPORTED", "review", live & (status == "UNSUPPORTED") & ~F.col("material")),
        ("POLICY_REFERENCE", "fail", live & has("policy_name") & ~vouched),
        ("NUMBER_CHECK", "fail", live & F.col("number_failed") & ~vouched),
        ("SLIDE2", "fail", live & has("slide2")),
        ("DIRTY", "fail", live & (F.col("state") == "DIRTY")),
        ("NEEDS_REVIEW", "review", live & (status == "NEEDS_REVIEW")),
        ("QUALIFIER_NOT_RENDERED", "review", live & hidden),
        ("ATTESTED", "review", live & vouched),
        ("REPAIR_FAILED", "review", live & (F.col("n_repairs") > 0) & status.isin("NEEDS_REVIEW", "UNSUPPORTED", "CONTRADICTED")),
    ]


def qualifier_shown(policy_id: Column, wanted: Column, shown: Column, longest: int = 200) -> Column:
    """A qualifier is shown if it can be (short, without a backtick before a digit) and the statement carries it."""
    return F.coalesce(policy_id.isNotNull() & (wanted != "") & (F.length(wanted) <= longest) & ~wanted.rlike(r"`\s?\d") & (shown == wanted), F.lit(False))


# Fixed values: (policy, pattern, message) of wordings that a brochure does not bear out.
WORDING_RULES = (
    ("POL-NIVA", r"(?i)\bday[- ]?care\b", "write the hours of hospitalisation, not day care"),
    ("POL-CARE", r"(?i)\b\d+\s*(?:healthy\s*)?days?\b[^.;]{0,20}\b(?:or more|at least)\b|\b(?:at least|or more)\b[^.;]{0,20}\b\d+\s*(?:healthy\s*)?days?\b", "give the days as the grid has them"),
)


def claim_problems(claims: DataFrame, aliases: dict[str, list[str]], rules: tuple = WORDING_RULES) -> DataFrame:
    """(claim_id, problems) of a deck's statements, in the order of the rules. ``claims``: claim_id, slide, claim_type, policy_id,
    text, match_id, selected (policy), compared (policies), from_selection, n_cited, risk (a basis fact is a business risk),
    framing, absence_errors."""
    text, policy = F.col("text"), F.col("policy_id")
    allowed = F.when(F.col("from_selection"), F.array_union(F.array("selected"), F.col("compared"))).otherwise(F.array("selected"))
    own = F.when(F.col("from_selection"), F.array_compact(F.array(policy))).otherwise(F.array("selected"))
    others = F.array_except(t.names(aliases, t.normalised(text)), own)
    row = (text == NOT_STATED_TEXT) & F.col("match_id").isNotNull()
    about = F.startswith("claim_type", F.lit("POLICY_")) & policy.isNotNull() & ~row
    silent = p.says_not_stated(text) & (F.size("absence_errors") == 0)
    found = F.concat(
        F.array_compact(F.array(
            F.when(policy.isNotNull() & ~F.array_contains(allowed, policy), "is about another policy"),
            F.when(F.size(others) > 0, F.concat(F.lit("names "), F.array_join(others, ", "))),
            F.when(text.rlike(r"`\s?\d"), "has a backtick before a digit"),
            F.when(~F.col("slide").isin(1, 2) & F.col("risk"), "uses a business risk outside slide 1"),
            F.when((F.col("slide") == 2) & ~F.col("claim_type").isin("CAPABILITY_STATEMENT", "NON_FACTUAL"), "slide 2 has records only"),
            *[F.when((policy == key) & text.rlike(pattern), message) for key, pattern, message in rules],
        )),
        F.when(about, F.col("absence_errors")).otherwise(F.array().cast(STRINGS)),
        F.array_compact(F.array(
            F.when(about & (F.col("n_cited") == 0) & ~silent, "cites no evidence"),
            F.when(F.col("framing") & ~p.complete_sentence(text), "is no complete sentence"),
        )),
    )
    return claims.select("claim_id", found.alias("problems"))


def cell_absence_errors(claims: DataFrame, cells: DataFrame, known: tp.Terms, names: tuple[str, ...] = ()) -> DataFrame:
    """(claim_id, errors): what the coverage cells hold against statements of absence. ``claims``: claim_id, policy_id, text."""
    c = stored(claims.withColumn("exposures", F.array_distinct(F.filter(F.transform(tp.hits(t.normalised("text"), known, names), lambda h: h["topic"]), lambda x: F.startswith(x, F.lit("EXP-"))))))
    c = c.withColumn("silent", p.says_not_stated(F.col("text"))).withColumn("absent", p.says_absence(F.col("text")))
    found = c.where("silent or absent").select("claim_id", "policy_id", "silent", F.explode("exposures").alias("exposure_id")).join(cells, ["policy_id", "exposure_id"], "left")
    fine = F.col("evidenced") & F.col("status").isin("EXCLUDED", "COVERED_VIA_ADDON")
    error = F.when(F.col("silent"), F.when(F.col("status") != "NOT_STATED", F.concat_ws(" ", "exposure_id", F.lit("is"), "status")))
    error = error.when(F.col("status").isNull(), F.concat_ws(" ", "exposure_id", F.lit("has no cell"))).when(fine, None).when(F.col("status") == "NOT_STATED", F.concat_ws(" ", "exposure_id", F.lit("is NOT_STATED"))).otherwise(F.concat_ws(" ", "exposure_id", F.lit("is"), "status"))
    by = found.groupBy("claim_id").agg(F.array_sort(F.array_compact(F.collect_list(error))).alias("e"))
    d = c.join(by, "claim_id", "left")
    unnamed = (F.col("silent") | F.col("absent")) & (F.size("exposures") == 0)
    return d.select("claim_id", F.when(unnamed, F.array(F.lit("names no exposure"))).otherwise(_array("e")).alias("errors"))
