"""Statements and company facts: construction, splitting, profiles, decks and repairs. ``audit`` judges them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veridock.functions import textnorm as t


def company_claims(drafts: DataFrame, facts: DataFrame, keys: tuple[str, ...] = ("claim_id", "text")) -> DataFrame:
    """Statements with the facts they may rest on: unknown facts go, none left means no statement, all from the web makes it
    a fact, otherwise it is marked as an assumption."""
    rows = drafts.select(*keys, F.posexplode("basis_fact_ids").alias("_p", "fact_id")).join(facts.select("fact_id", "status"), "fact_id")
    g = rows.groupBy(*keys).agg(F.bool_and(F.col("status") == "WEB_SOURCED").alias("_web"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_p", "fact_id"))), lambda x: x["fact_id"])).alias("basis_fact_ids"))
    return g.select(*keys[:-1], F.when(F.col("_web"), F.col(keys[-1])).otherwise(F.concat(t.unlabelled(keys[-1]), F.lit("*"))).alias(keys[-1]), F.when(F.col("_web"), "COMPANY_FACT").otherwise("ASSUMPTION").alias("claim_type"), "basis_fact_ids")


def split_by_provenance(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """A statement that mixes web and assumed facts becomes one for each fact; others stay."""
    rows = claims.select("claim_id", "ord", F.posexplode("basis_fact_ids").alias("place", "fact_id")).join(facts.select("fact_id", F.col("value").alias("fact_text"), (F.col("status") == "WEB_SOURCED").alias("web")), "fact_id")
    kinds = rows.groupBy("claim_id").agg(F.count_distinct("web").alias("kinds"))
    both = claims.join(kinds, "claim_id", "left")
    whole = both.where("coalesce(kinds, 0) < 2").select("claim_id", "ord", F.lit(0).alias("place"), "text", "basis_fact_ids")
    parts = rows.join(kinds.where("kinds > 1").select("claim_id"), "claim_id", "left_semi").select("claim_id", "ord", "place", F.when(F.col("web"), F.col("fact_text")).otherwise(F.concat("fact_text", F.lit("*"))).alias("text"), F.array("fact_id").alias("basis_fact_ids"))
    return whole.unionByName(parts)


def profile_fields(facts: DataFrame) -> DataFrame:
    """For each run and field the first value, web-sourced ones before others; the size is a head count if there is one.
    ``facts``: run_id, field, value, status, ord."""
    w = W.partitionBy("run_id", "field").orderBy(F.when(F.col("status") == "WEB_SOURCED", 0).otherwise(1), "ord")
    first = facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").groupBy("run_id").pivot("field", ["industry", "headcount_band", "size"]).agg(F.first("value"))
    none = F.lit("Not available")
    return first.select("run_id", F.coalesce("industry", none).alias("industry"), F.coalesce("headcount_band", "size", none).alias("size"))


def flattened(slides: DataFrame) -> DataFrame:
    """A deck's nested slides as statements in order: bullets, then benefit and condition of each row, then limitations.
    ``slides``: run_id, slide_number, bullets, rows (array of struct<benefit, condition>), limitations."""
    part = lambda name, order, c: slides.select("run_id", "slide_number", F.lit(order).alias("_part"), F.lit(name).alias("slot"), F.posexplode(c).alias("_p", "text")).withColumn("_q", F.lit(0))
    rows = slides.select("run_id", "slide_number", F.lit(1).alias("_part"), F.posexplode("rows").alias("_p", "r"))
    cells = rows.select("run_id", "slide_number", "_part", F.lit("benefit").alias("slot"), "_p", F.col("r.benefit").alias("text"), F.lit(0).alias("_q")).unionByName(rows.select("run_id", "slide_number", "_part", F.lit("condition").alias("slot"), "_p", F.col("r.condition").alias("text"), F.lit(1).alias("_q")))
    every = part("bullet", 0, "bullets").unionByName(cells).unionByName(part("limitation", 2, "limitations"))
    w = W.partitionBy("run_id").orderBy("slide_number", "_part", "_p", "_q")
    return every.withColumn("ord", F.row_number().over(w)).select("run_id", F.concat(F.lit("CL-"), F.lpad(F.col("ord").cast("string"), 3, "0")).alias("claim_id"), "ord", "slide_number", "slot", "text")


def repaired(attempts: DataFrame, most: int = 2) -> DataFrame:
    """The outcome of repair attempts (claim_id, attempt, text, status, material): a missing rewrite ends the repair, the
    first that does not fail is taken, and what still fails is removed unless it is material."""
    w = W.partitionBy("claim_id").orderBy("attempt")
    live = attempts.where(F.col("attempt") <= most).withColumn("_stop", F.max(F.col("text").isNull().cast("int")).over(w)).where("_stop = 0")
    fails = F.col("status").isin("UNSUPPORTED", "CONTRADICTED")
    done = live.withColumn("_ok", (~fails).cast("int")).groupBy("claim_id").agg(F.max("_ok").alias("_ok"), F.min_by(F.struct("text", "status", "attempt"), F.struct((1 - F.col("_ok")), F.when(F.col("_ok") == 1, F.col("attempt")).otherwise(-F.col("attempt")))).alias("r"))
    every = attempts.groupBy("claim_id").agg(F.bool_or("material").alias("material")).join(done, "claim_id", "left")
    fixed = F.coalesce(F.col("_ok") == 1, F.lit(False))
    return every.select("claim_id", F.when(fixed, F.col("r.text")).alias("text"), F.when(fixed, "REPAIRED").when(F.col("material"), "REPAIR_FAILED").otherwise("REMOVED").alias("outcome"), F.col("r.attempt").alias("attempts"))
