"""Sinks: whole tables, append-only logs, report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTORS = ("system", "rules", "llm", "advisor")


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """All or nothing: readers see the old table or the new one, by the commit protocol."""
    df.write.mode("overwrite").format(kind).save(path)


def append_log(df: DataFrame, path: str) -> None:
    """Entries are only ever added; actors outside the closed set are refused before anything is written."""
    bad = df.where(~F.col("actor").isin(*ACTORS)).limit(1).count()
    if bad:
        raise ValueError("unknown actor")
    df.write.mode("append").json(path)


def report(results: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One nested row for each statement: its result and the evidence it rests on, missing items marked."""
    ids = results.select("claim_id", F.posexplode("supporting_evidence_ids").alias("_p", "evidence_id"))
    seen = ids.join(evidence.select("evidence_id", "document_id", "page", "text"), "evidence_id", "left")
    view = seen.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("_p", "evidence_id", "document_id", "page", "text", F.col("document_id").isNull().alias("missing")))).alias("evidence"))
    return results.join(claims.select("claim_id", F.col("text").alias("claim_text"), "ord"), "claim_id", "left").join(view, "claim_id", "left")


def report_markdown(rows: DataFrame) -> DataFrame:
    """The report as one Markdown row a statement."""
    cell = lambda c: F.translate(F.coalesce(c, F.lit("-")), "|\n", "/ ")
    pages = F.array_join(F.transform(F.coalesce("evidence", F.array().cast("array<struct<_p:int,evidence_id:string,document_id:string,page:int,text:string,missing:boolean>>")), lambda e: F.concat(e["evidence_id"], F.when(e["missing"], " (missing)").otherwise(""))), ", ")
    return rows.select("ord", F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("claim_id")), cell(F.col("status")), cell(F.col("claim_text")), pages), F.lit(" |")).alias("line"))


def evidence_dump(evidence: DataFrame) -> DataFrame:
    """For each document: counts by type, then its items in order."""
    counts = evidence.groupBy("document_id", "item_type").count().groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "item_type", F.col("count").cast("string")))), ", ").alias("line"))
    head = counts.select("document_id", F.lit(-1).alias("ord"), "line")
    rows = evidence.select("document_id", "ord", F.concat_ws(" | ", "evidence_id", F.col("page").cast("string"), "item_type", F.translate("text", "|\n", "/ ")).alias("line"))
    return head.unionByName(rows)


def timing_report(steps: DataFrame) -> DataFrame:
    """Total, slowest step and number of failed steps of each run."""
    top = steps.where("parent is null")
    slow = top.groupBy("run_id").agg(F.max_by(F.struct("name", "seconds"), F.struct("seconds", -F.col("index"))).alias("s"), F.sum("seconds").alias("total"))
    fails = steps.groupBy("run_id").agg(F.count_if(F.col("status") != "ok").alias("n_failed"), F.sum("model_calls").alias("n_calls"))
    return slow.join(fails, "run_id").select("run_id", "total", F.col("s.name").alias("slowest"), F.col("s.seconds").alias("slowest_seconds"), "n_failed", "n_calls")
