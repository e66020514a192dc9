"""Queries that read quantities out of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridock.functions import quantity as q
from veridock.plans.registry import query
from veridock.session import spread, table


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice) AS DOUBLE) AS amount, CAST(l_quantity AS DOUBLE) * CASE l_linenumber % 3 WHEN 0 THEN 24 WHEN 1 THEN 1 ELSE 12 END AS span,
 CASE l_linenumber % 3 WHEN 0 THEN 'HOURS' WHEN 1 THEN 'MONTHS' ELSE 'MONTHS' END AS family, round(l_discount * 100) AS share, 3 AS n FROM lineitem""")
def stated_amounts(spark, sf_dir):
    """Amounts, spans and shares written into sentences and read back, spans in base units: N1 N4."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    unit = F.element_at(F.array(F.lit("days"), F.lit("months"), F.lit("years")), F.expr("cast(l_linenumber % 3 + 1 as int)"))
    amount = F.format_string("%.0f", F.round("l_extendedprice"))
    text = F.concat(F.lit("Cover up to INR "), amount, F.lit(" after "), F.format_string("%.0f", F.col("l_quantity").cast("double")), F.lit(" "), unit, F.lit(" of waiting, with "), F.format_string("%.0f", F.round(F.col("l_discount") * 100)), F.lit("% co-payment"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", q.quantities(text).alias("q"))
    one = lambda i: F.get("q", F.lit(i))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", one(0)["value"].alias("amount"), q.in_base(one(1)["unit"], one(1)["value"]).alias("span"), q.family(one(1)["unit"]).alias("family"), one(2)["value"].alias("share"), F.size("q").alias("n"))


_SHARE = r"([0-9]+(?:,[0-9]{2,3})*(?:\.[0-9]+)?)\s{0,2}%"


@query(f"""WITH t AS (SELECT 'documents' AS origin, doc_id AS a, CAST(NULL AS BIGINT) AS b, text FROM documents UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations),
  s AS (SELECT origin, a, b, unnest(regexp_extract_all(text, '{_SHARE}', 1)) AS raw FROM t) SELECT origin, a, b, count(*) AS n, sum(CAST(replace(raw, ',', '') AS DOUBLE)) AS total FROM s GROUP BY ALL""")
def stated_shares(spark, sf_dir):
    """The percentages that documents and conversations state, of all quantities read in them: N1."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("a"), F.col("turn").alias("b"), "text")
    rows = spread(docs.unionByName(turns)).select("origin", "a", "b", F.explode(q.quantities(F.col("text"), False)).alias("q")).where("q.unit = 'PERCENT' and endswith(q.raw, '%')")  # without those that a list shares
    return rows.groupBy("origin", "a", "b").agg(F.count("*").alias("n"), F.sum("q.value").alias("total"))


@query(r"""SELECT p_partkey, CAST(replace(regexp_extract(p_name || ' no ' || p_size || ' at INR ' || CAST(round(p_retailprice) AS BIGINT), 'INR ([0-9]+)', 1), ',', '') AS DOUBLE) AS price, 1 AS n FROM part""")
def priced_parts(spark, sf_dir):
    """Prices read from sentences about parts, whose sizes stand behind a label and are passed over: N1 N4."""
    text = F.concat_ws(" ", F.regexp_replace("p_name", r"[0-9]", ""), F.lit("No."), F.col("p_size").cast("string"), F.lit("at INR"), F.format_string("%.0f", F.round("p_retailprice")))
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", q.quantities(text).alias("q"))
    return rows.select("p_partkey", F.get("q", F.lit(0))["value"].alias("price"), F.size("q").alias("n"))
