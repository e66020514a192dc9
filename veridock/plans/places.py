"""Queries on places: boxes made of order lines (days on the shelf across, price up), and clusters of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.operators import joins, ordered
from veridock.plans.registry import query
from veridock.plans.text import _norm
from veridock.session import spread, table

#: Prices less than this above the first of their cluster belong to it.
GAP = 2000.0
#: How far a frame reaches around its line: days to both sides, price up and down.
DAYS, PRICE = 10, 800.0

_BOXES = "SELECT *, l_returnflag || l_linestatus AS page, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS x0, x0 + l_quantity AS x1, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "lineitem").withColumns({"page": F.concat("l_returnflag", "l_linestatus"), "x0": day, "x1": day + F.col("l_quantity"), "y": F.col("l_extendedprice").cast("double")})


@query(f"""WITH b AS ({_BOXES}), h AS (SELECT page, x0, x1, y, l_orderkey * 10 + l_linenumber AS hid FROM b WHERE l_discount >= 0.1),
 d AS (SELECT DISTINCT page, x0, x1, y FROM b), m AS (SELECT d.page, d.x0, d.x1, d.y, min(struct_pack(gap := abs(h.y - d.y), hid := h.hid)) AS best FROM d JOIN h ON d.page = h.page AND h.y >= d.y - 2 AND h.x0 < d.x1 AND h.x1 > d.x0 GROUP BY ALL)
 SELECT b.l_orderkey, b.l_linenumber, b.l_partkey, best.hid AS heading, best.gap AS gap FROM b JOIN m USING (page, x0, x1, y)""")
def nearest_headings(spark, sf_dir):
    """Each order line with the much discounted line that is the nearest above it in price while both are on the shelf: J19."""
    b = _boxes(spark, sf_dir)
    heads = b.where("l_discount >= 0.1").selectExpr("page", "l_orderkey * 10 + l_linenumber as hid", "x0 as hx0", "x1 as hx1", "y as bottom")
    rows = b.selectExpr("page", "l_orderkey", "l_linenumber", "l_partkey", "x0", "x1", "y as top")
    found = joins.closest_above(rows, heads, width=50.0, height=500.0)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.col("hid").alias("heading"), F.abs(F.col("bottom") - F.col("top")).alias("gap"))


@query(f"""WITH named AS (SELECT p_partkey, {_norm('p_name')} AS shown, {_norm("split_part(p_name, ' ', 1)")} AS wanted FROM part), b AS (SELECT bx.*, shown, wanted FROM ({_BOXES}) bx JOIN named ON l_partkey = p_partkey),
 f AS (SELECT page, x0 - {DAYS} AS x0, x1 + {DAYS} AS x1, y - {PRICE} AS y0, y + {PRICE} AS y1, shown FROM b WHERE l_tax >= 0.08)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM b WHERE l_discount < 0.05 AND NOT EXISTS (FROM f WHERE f.page = b.page AND b.x0 >= f.x0 - 3 AND b.x1 <= f.x1 + 3 AND b.y >= f.y0 - 3 AND b.y <= f.y1 + 3 AND contains(f.shown, b.wanted))""")
def unframed_lines(spark, sf_dir):
    """Little discounted order lines that lie in no frame of a highly taxed line whose part's name has the first word of theirs: J20."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    b = _boxes(spark, sf_dir).join(names, "l_partkey")
    frames = b.where("l_tax >= 0.08").selectExpr("page", f"x0 - {DAYS} as x0", f"y - {PRICE} as y0", f"x1 + {DAYS} as x1", f"y + {PRICE} as y1", "p_name as text")
    rows = b.where("l_discount < 0.05").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "page", "x0", F.col("y").alias("y0"), "x1", F.col("y").alias("y1"), F.split("p_name", " ")[0].alias("text"))
    return joins.not_contained(spread(rows), frames, width=400.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""WITH RECURSIVE v AS MATERIALIZED (SELECT DISTINCT l_returnflag AS g, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
 a AS (SELECT g, min(y) AS y, 1 AS cluster FROM v GROUP BY g UNION ALL SELECT g, (SELECT min(v.y) FROM v WHERE v.g = a.g AND v.y - a.y >= {GAP}), cluster + 1 FROM a WHERE EXISTS (FROM v WHERE v.g = a.g AND v.y - a.y >= {GAP}))
 SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, a.cluster AS cluster FROM lineitem ASOF JOIN a ON l_returnflag = a.g AND CAST(l_extendedprice AS DOUBLE) >= a.y""")
def price_clusters(spark, sf_dir):
    """Lines of a return flag in clusters of prices, each measured from its first: O4 O14. A third of the table is one group."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice")
    return ordered.clustered(lines, ["l_returnflag"], "l_extendedprice", GAP).drop("l_extendedprice")
