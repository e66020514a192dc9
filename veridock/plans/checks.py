"""Audits of statements on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridock.operators import checks
from veridock.plans.registry import query
from veridock.plans.text import _EDGES, _norm
from veridock.session import table

#: Of the statements: how many different passages they cite, which is more than there are on small tables.
CITED = 50


@query(f"""WITH e AS (SELECT item_id, CASE WHEN item_id % 9 = 4 THEN 'B' ELSE 'A' END AS holder, item_id % 7 <> 3 AS citable, regexp_replace(text, '[0-9]', '', 'g') AS body, CAST(100 + item_id * 10 AS DOUBLE) AS amount, CAST((item_id % 20 + 2) * 12 AS DOUBLE) AS months, item_id % 3 = 0 AS boundless FROM benchmark),
 ev AS (SELECT *, {_norm('body')} AS s, split_part(body, chr(10), 1) AS line FROM e),
 c AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 5 THEN 'B' ELSE 'A' END AS owner, [x FOR x IN ['VERIFIED', 'VERIFIED', 'VERIFIED_WITH_QUALIFIER', 'CONTRADICTED', NULL]][CAST((conv_id + turn) % 5 AS INTEGER) + 1] AS given,
   (conv_id * 3 + turn) % {CITED} AS first, (turn * 5 + conv_id) % {CITED} AS second, conv_id % 4 = 1 AS boundless FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
 num AS (SELECT conv_id, turn, 'INR' AS family, CAST(100 + first * 10 + CASE WHEN turn % 3 = 1 THEN 7 ELSE 0 END AS DOUBLE) AS n FROM c UNION ALL SELECT conv_id, turn, 'MONTHS', CAST((first % 20 + 2) * 12 AS DOUBLE) FROM c WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'PERCENT', CAST(turn % 90 + 1 AS DOUBLE) FROM c WHERE conv_id % 10 = 7),
 link AS (SELECT conv_id, turn, owner, first AS item_id, true AS quoting FROM c UNION ALL SELECT conv_id, turn, owner, second, false FROM c WHERE conv_id % 3 = 0),
 own AS (SELECT DISTINCT conv_id, turn, item_id, amount, months, boundless FROM link JOIN ev USING (item_id) WHERE holder = owner AND citable),
 held AS (SELECT conv_id, turn, bool_or(holder <> owner) AS strange FROM link LEFT JOIN ev USING (item_id) GROUP BY ALL),
 given AS (SELECT conv_id, turn, 'INR' AS family, amount AS g FROM own UNION ALL SELECT conv_id, turn, 'MONTHS', months FROM own),
 met AS (SELECT n.conv_id, n.turn, n.family, n.n, bool_or(abs(n - g) <= 0.005 * greatest(n, g)) AS same FROM num n LEFT JOIN given g ON n.conv_id = g.conv_id AND n.turn = g.turn AND n.family = g.family GROUP BY ALL),
 judged AS (SELECT conv_id, turn, max(CASE WHEN same THEN 0 WHEN same IS NULL THEN 3 ELSE 4 END) AS number FROM met GROUP BY ALL),
 q AS (SELECT c.conv_id, c.turn, ev.s AS body, CASE WHEN c.turn % 4 = 2 THEN 'never said ' || {_norm('line')} ELSE {_norm('line')} END AS s FROM c JOIN ev ON item_id = first WHERE holder = owner AND citable),
 quoted AS (SELECT conv_id, turn, s <> '' AND contains(body, s) AND regexp_matches(body, {_EDGES}) AS quoted FROM q),
 d AS (SELECT c.*, coalesce(strange, false) AS strange, EXISTS (FROM own o WHERE o.conv_id = c.conv_id AND o.turn = c.turn) AS has, coalesce(quoted, false) AS quoted, number, EXISTS (FROM own o WHERE o.conv_id = c.conv_id AND o.turn = c.turn AND o.boundless) AS backed, coalesce(given IN ('VERIFIED', 'VERIFIED_WITH_QUALIFIER'), false) AS good
   FROM c LEFT JOIN held USING (conv_id, turn) LEFT JOIN judged USING (conv_id, turn) LEFT JOIN quoted USING (conv_id, turn)),
 f AS (SELECT *, strange OR (good AND NOT has) AS f_owner, good AND has AND NOT quoted AS f_quote, number > 0 AS f_number, boundless AND NOT backed AS f_absolute, CASE coalesce(given, 'NEEDS_REVIEW') WHEN 'VERIFIED' THEN 0 WHEN 'VERIFIED_WITH_QUALIFIER' THEN 1 WHEN 'NEEDS_REVIEW' THEN 2 ELSE 4 END AS severity FROM d)
 SELECT conv_id, turn, given AS llm_status, ['VERIFIED', 'VERIFIED_WITH_QUALIFIER', 'NEEDS_REVIEW', 'UNSUPPORTED', 'CONTRADICTED'][greatest(severity, number, CASE WHEN f_owner THEN 3 ELSE 0 END, CASE WHEN f_quote OR f_absolute THEN 2 ELSE 0 END) + 1] AS status,
  CASE number WHEN 0 THEN 'PASS' WHEN 3 THEN 'FAIL_MISSING' ELSE 'FAIL_CONTRADICTED' END AS number_check, array_to_string([x FOR x IN [CASE WHEN f_owner THEN 'ownership' END, CASE WHEN f_quote THEN 'quotes' END, CASE WHEN f_number THEN 'numbers' END, CASE WHEN f_absolute THEN 'absolute' END] IF x IS NOT NULL], ',') AS failed FROM f""")
def audited_statements(spark, sf_dir):
    """Statements made from turns, which cite passages and quote their first line, some with words or amounts that the passages
    do not have: R2 (ownership, quotes, numbers, absolute wordings), F2 N1 N4 N5 N6 N7 A16."""
    amount = lambda i: F.format_string("%d", 100 + i * 10)
    body = F.regexp_replace("text", "[0-9]", "")
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("evidence_id"), F.when(F.expr("item_id % 9 = 4"), "B").otherwise("A").alias("owner"), F.expr("item_id % 7 <> 3").alias("citable"), body.alias("body"),
        F.concat(body, F.lit("\nIt pays up to INR "), amount(F.col("item_id")), F.lit(" after "), F.format_string("%d", F.expr("item_id % 20 + 2")), F.lit(" years."), F.when(F.expr("item_id % 3 = 0"), " Its cover is unlimited.").otherwise("")).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    made = turns.withColumn("claim_id", F.struct("conv_id", "turn")).withColumn("first", F.expr(f"(conv_id * 3 + turn) % {CITED}")).withColumn("second", F.expr(f"(turn * 5 + conv_id) % {CITED}"))
    text = F.concat(
        F.lit("It pays INR "), F.format_string("%d", 100 + F.col("first") * 10 + F.when(F.expr("turn % 3 = 1"), 7).otherwise(0)), F.when(F.expr("turn % 2 = 0"), F.concat(F.lit(" after "), F.format_string("%d", (F.expr("first % 20") + 2) * 12), F.lit(" months"))).otherwise(""),
        F.when(F.expr("conv_id % 10 = 7"), F.concat(F.lit(", at "), F.format_string("%d", F.expr("turn % 90 + 1")), F.lit("% of the cost"))).otherwise(""), F.when(F.expr("conv_id % 4 = 1"), ", unlimited.").otherwise("."),
    )
    given = F.get(F.array(F.lit("VERIFIED"), F.lit("VERIFIED"), F.lit("VERIFIED_WITH_QUALIFIER"), F.lit("CONTRADICTED"), F.lit(None)), F.expr("cast((conv_id + turn) % 5 as int)"))
    claims = made.select("claim_id", F.when(F.expr("conv_id % 11 = 5"), "B").otherwise("A").alias("owner"), text.alias("text"), given.alias("status"))
    lines = items.select(F.col("evidence_id").alias("first"), F.split("body", "\n")[0].alias("line"))
    quoting = made.join(lines, "first", "left").select("claim_id", F.col("first").alias("evidence_id"), F.when(F.expr("turn % 4 = 2"), F.concat(F.lit("never said "), F.col("line"))).otherwise(F.upper("line")).alias("quote"))
    citations = quoting.unionByName(made.where("conv_id % 3 = 0").select("claim_id", F.col("second").alias("evidence_id"), F.lit(None).cast("string").alias("quote")))
    return checks.audited(claims, citations, items.drop("body")).select("claim_id.*", "llm_status", "status", "number_check", F.array_join("failed", ",").alias("failed"))
