"""Checks of statements as rows: one row for each claim and check, one aggregate for the verdict.

``audit`` judges a claim in one expression over arrays. Here every mention (a cited item, a quote, a number, an absolute
wording) is a row of its own, joined to what may support it, so that the plan is small, nothing is collected into arrays, and a
claim that cites very much, or an item that very many claims cite, is dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions import predicates as p
from veridock.functions import quantity as q
from veridock.functions import textnorm as t
from veridock.operators import rules as r
from veridock.operators.audit import GOOD
from veridock.session import spread, stored

#: The checks in the order in which they are reported.
CHECKS = ("ownership", "quotes", "numbers", "absolute")


def _mentions(numbers: Column) -> Column:
    """Quantities as (place, family, value in base units)."""
    return F.posexplode(F.transform(numbers, lambda x: F.struct(q.family(x["unit"]).alias("family"), q.in_base(x["unit"], x["value"]).alias("base"))))


def number_checks(said: DataFrame, cited: DataFrame, given: DataFrame) -> DataFrame:
    """(claim_id, status) of each number of a claim: PASS if an item that the claim cites states it, FAIL_CONTRADICTED if they
    state only others of its family, FAIL_MISSING if none. ``said``: claim_id, place, family, base; ``cited``: claim_id,
    evidence_id; ``given``: evidence_id, family, base."""
    mine = said.withColumnRenamed("base", "claimed")
    met = mine.join(cited, "claim_id").join(given, ["evidence_id", "family"]).groupBy("claim_id", "place").agg(F.bool_or(q.close(F.col("claimed"), F.col("base"))).alias("same"))
    return mine.join(met, ["claim_id", "place"], "left").select("claim_id", F.when(F.col("same"), "PASS").when(F.col("same").isNull(), "FAIL_MISSING").otherwise("FAIL_CONTRADICTED").alias("status"))


def audited(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdicts after the checks that need no reviewer: claim_id, llm_status, status, number_check, failed (array of checks).

    ``claims``: claim_id (unique), owner, text, status (the reviewer's; null: none, which needs review). ``citations``:
    claim_id, evidence_id, quote (null: none is given). ``evidence``: evidence_id (unique), owner, citable, text.
    Ownership: no cited item is another owner's, and a supported claim cites one of its own that may be cited. Quotes: a supported
    claim has quotes, all of which stand verbatim in their items. Numbers: as ``number_checks``. Absolute: an absolute
    wording stands in a cited item too. A failed check only makes a status worse. Null texts count as empty; citations of
    unknown items are no support, and not foreign; repeated ones count once. Claims without an id cite nothing, and share what fails for
    any of them."""
    text = F.coalesce("text", F.lit(""))
    c = stored(spread(claims.select("claim_id", "owner", text.alias("text"), "status")).withColumn("numbers", q.quantities(F.col("text"), False)).withColumn("absolute", p.overstatements(F.col("text"), F.lit(""))).drop("text"))
    e = stored(spread(evidence.select("evidence_id", F.col("owner").alias("holder"), "citable", text.alias("text"))).withColumn("form", t.normalised("text")).withColumn("numbers", q.quantities(F.col("text"))))
    supported = F.coalesce(F.col("status").isin(*GOOD), F.lit(False))
    named = citations.select("claim_id", "evidence_id", "quote").distinct()
    own = F.coalesce(F.col("holder") == F.col("owner"), F.lit(False)) & F.coalesce("citable", F.lit(False))
    links = stored(named.join(c.select("claim_id", "owner"), "claim_id").join(e.select("evidence_id", "holder", "citable"), "evidence_id", "left").select("claim_id", "evidence_id", "quote", own.alias("own"), F.coalesce(F.col("holder") != F.col("owner"), F.lit(False)).alias("foreign")))
    cited = links.where("own").select("claim_id", "evidence_id").distinct()

    missing = F.exists(F.regexp_extract_all(F.col("quote"), F.lit(r"(\(\d{1,2}\))")), lambda m: ~F.contains("text", m))
    said = links.where("quote is not null").join(e.select("evidence_id", "text", "form"), "evidence_id", "left")
    said = said.withColumn("wanted", F.when(missing, t.normalised("quote", keep_paren=True)).otherwise(t.normalised("quote")))
    stands = F.col("own") & F.coalesce(t.bounded_in("wanted", F.coalesce("form", F.lit(""))), F.lit(False))
    quotes = said.groupBy("claim_id").agg(F.bool_and(stands).alias("quoted"))
    held = links.groupBy("claim_id").agg(F.bool_or("foreign").alias("foreign"), F.bool_or("own").alias("has_own"))

    numbers = number_checks(c.select("claim_id", _mentions(F.col("numbers")).alias("place", "n")).select("claim_id", "place", "n.*"), cited, e.select("evidence_id", _mentions(F.col("numbers")).alias("_", "n")).select("evidence_id", "n.*").distinct())
    wordings = c.select("claim_id", F.explode("absolute").alias("wording"))
    bodies = wordings.join(cited, "claim_id").join(e.select("evidence_id", "form"), "evidence_id").groupBy("claim_id", "wording").agg(F.bool_or(F.size(p.overstatements(F.col("wording"), F.col("form"))) == 0).alias("backed"))
    loose = wordings.join(bodies, ["claim_id", "wording"], "left").where("not coalesce(backed, false)")

    base = c.select("claim_id", supported.alias("supported")).join(held, "claim_id", "left").join(quotes, "claim_id", "left")
    has = F.coalesce("has_own", F.lit(False))
    unowned = F.coalesce("foreign", F.lit(False)) | (F.col("supported") & ~has)
    unquoted = F.col("supported") & has & ~F.coalesce("quoted", F.lit(False))
    row = lambda check, cap: (F.lit(CHECKS.index(check)).alias("check"), F.lit(r.SEVERITY[cap]).alias("cap"))
    failed = base.where(unowned).select("claim_id", *row("ownership", "UNSUPPORTED")).unionByName(base.where(unquoted).select("claim_id", *row("quotes", "NEEDS_REVIEW")))
    failed = failed.unionByName(numbers.where("status = 'FAIL_CONTRADICTED'").select("claim_id", *row("numbers", "CONTRADICTED"))).unionByName(numbers.where("status = 'FAIL_MISSING'").select("claim_id", *row("numbers", "UNSUPPORTED")))
    failed = failed.unionByName(loose.select("claim_id", *row("absolute", "NEEDS_REVIEW"))).unionByName(numbers.where("status = 'PASS'").select("claim_id", F.lit(-1).alias("check"), F.lit(0).alias("cap")))
    number = F.max(F.when(F.col("check").isin(-1, CHECKS.index("numbers")), F.col("cap")))
    worst = failed.groupBy("claim_id").agg(F.max("cap").alias("worst"), F.array_sort(F.collect_set(F.when(F.col("check") >= 0, F.col("check")))).alias("checks"), number.alias("number"))

    d = c.select("claim_id", "status").join(worst.withColumnRenamed("claim_id", "_claim"), F.col("claim_id").eqNullSafe(F.col("_claim")), "left")
    names, statuses = F.array(*[F.lit(x) for x in CHECKS]), F.array(*[F.lit(x) for x in r.SEVERITY])
    given = F.coalesce("status", F.lit("NEEDS_REVIEW"))
    status = F.when(F.coalesce("worst", F.lit(0)) > r.severity(given), F.element_at(statuses, F.col("worst") + 1)).otherwise(given)
    check = F.when(F.col("number").isNull(), "NA").when(F.col("number") == 0, "PASS").when(F.col("number") == r.SEVERITY["CONTRADICTED"], "FAIL_CONTRADICTED").otherwise("FAIL_MISSING")
    return d.select("claim_id", F.col("status").alias("llm_status"), status.alias("status"), check.alias("number_check"), F.coalesce(F.transform("checks", lambda i: F.element_at(names, i + 1)), F.array().cast("array<string>")).alias("failed"))
