"""Relational queries on the star schema and the event log: each exercises operators of the evidence model on the driver's
tables, which stand in for evidence, claims, cells and logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veridock.functions import quantity as q
from veridock.operators import joins, ordered, rules
from veridock.plans.registry import query
from veridock.session import table

_STATUS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'CONTRADICTED' WHEN '2-HIGH' THEN 'NEEDS_REVIEW' WHEN '3-MEDIUM' THEN 'VERIFIED_WITH_QUALIFIER' WHEN '5-LOW' THEN 'NON_FACTUAL' ELSE 'VERIFIED' END"


def _claims(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.expr(_STATUS).alias("status"))


@query(f"""SELECT o_orderstatus, count(*) FILTER (s = 'VERIFIED') AS n_verified, count(*) FILTER (s = 'VERIFIED_WITH_QUALIFIER') AS n_verified_with_qualifier, count(*) FILTER (s = 'NEEDS_REVIEW') AS n_needs_review,
 count(*) FILTER (s = 'UNSUPPORTED') AS n_unsupported, count(*) FILTER (s = 'CONTRADICTED') AS n_contradicted, count(*) FILTER (s IN ('VERIFIED', 'VERIFIED_WITH_QUALIFIER')) / nullif(count(*) FILTER (s <> 'NON_FACTUAL'), 0) AS confidence,
 CASE WHEN bool_or(s IN ('UNSUPPORTED', 'CONTRADICTED')) THEN 'FAIL' WHEN bool_or(s = 'NEEDS_REVIEW') THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS flag FROM (SELECT o_orderstatus, {_STATUS} AS s, o_totalprice FROM orders) WHERE o_totalprice > 1000 GROUP BY o_orderstatus""")
def audit_summary(spark, sf_dir):
    """Status counts, confidence and flag of live statements: A1 A2 A3 C2."""
    return rules.summary(_claims(spark, sf_dir), ["o_orderstatus"], "status", F.col("o_totalprice") > 1000)


_LINE_RULES = (("CONTRADICTED", "fail", "l_returnflag = 'R' and l_linestatus = 'F' and l_discount >= 0.1"), ("NUMBER_CHECK", "fail", "l_quantity >= 50 and l_tax = 0"), ("NEEDS_REVIEW", "review", "l_returnflag = 'A' and l_tax > 0.07"), ("QUALIFIER", "review", "l_discount > 0.08 and l_returnflag = 'N'"))
_ITEMS_SQL = " UNION ALL ".join(f"SELECT l_orderkey, '{n}' AS item_id, '{k}' AS kind FROM lineitem WHERE {c}" for n, k, c in _LINE_RULES)


def _line_items(spark, sf_dir):
    return rules.gate_items(table(spark, sf_dir, "lineitem"), "l_orderkey", [(n, k, F.expr(c)) for n, k, c in _LINE_RULES])


@query(f"SELECT l_orderkey, item_id, kind, count(*) AS n FROM ({_ITEMS_SQL}) GROUP BY ALL")
def gate_items(spark, sf_dir):
    """Rules that hold, from one pass over the lines: A4 E2 P19."""
    return _line_items(spark, sf_dir).groupBy("l_orderkey", "item_id", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH i AS (SELECT DISTINCT l_orderkey, item_id, kind FROM ({_ITEMS_SQL})), a AS (SELECT DISTINCT o_orderkey AS l_orderkey, 'NEEDS_REVIEW' AS item_id FROM orders WHERE o_orderstatus = 'F')
SELECT l_orderkey, CASE WHEN bool_or(kind = 'fail') THEN 'FAIL' ELSE 'REVIEW_REQUIRED' END AS flag, count(*) FILTER (kind = 'fail') AS n_fail, count(*) FILTER (kind = 'review' AND a.item_id IS NULL) AS n_open,
 count(*) FILTER (kind = 'fail') = 0 AND count(*) FILTER (kind = 'review' AND a.item_id IS NULL) = 0 AS export_allowed FROM i LEFT JOIN a USING (l_orderkey, item_id) GROUP BY l_orderkey""".replace("a.item_id IS NULL", "ack IS NULL").replace("'NEEDS_REVIEW' AS item_id FROM orders", "'NEEDS_REVIEW' AS item_id, 1 AS ack FROM orders"))
def gate_flags(spark, sf_dir):
    """Gate of each run with acknowledged items subtracted: A5 X10."""
    items = _line_items(spark, sf_dir).select("l_orderkey", "item_id", "kind").distinct()
    acked = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("NEEDS_REVIEW").alias("item_id"))
    return rules.gate(items, acked, "l_orderkey")


@query("""WITH c AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 4 WHEN l_discount > 0.08 THEN 3 WHEN l_tax > 0.06 THEN 2 ELSE 0 END) AS worst FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE greatest(coalesce(worst, 0), CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'VERIFIED_WITH_QUALIFIER' WHEN 2 THEN 'NEEDS_REVIEW' WHEN 3 THEN 'UNSUPPORTED' ELSE 'CONTRADICTED' END AS status FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def severity_lattice(spark, sf_dir):
    """Status after all checks, which only lower it: A16 R2 R3 R4 X4."""
    check = F.when(F.expr("l_returnflag = 'R'"), "CONTRADICTED").when(F.expr("l_discount > 0.08"), "UNSUPPORTED").when(F.expr("l_tax > 0.06"), "NEEDS_REVIEW").otherwise("VERIFIED")
    checks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(check).alias("checks"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "VERIFIED_WITH_QUALIFIER").otherwise("VERIFIED").alias("s"))
    return orders.join(checks, orders.o_orderkey == checks.l_orderkey, "left").select("o_orderkey", rules.capped(F.col("s"), F.coalesce("checks", F.array().cast("array<string>"))).alias("status"))


@query(f"SELECT o_orderkey, {_STATUS} NOT IN ('UNSUPPORTED', 'CONTRADICTED') AND o_orderstatus <> 'F' AS rendered, {_STATUS} = 'CONTRADICTED' AND o_orderstatus <> 'F' AND month(o_orderdate) <> 2 AND o_totalprice < 200000 AS repairable FROM orders")
def rendered_and_repairable(spark, sf_dir):
    """Which statements are shown and which may be repaired: P5 P11 X6."""
    state = F.when(F.col("o_orderstatus") == "F", "REMOVED").otherwise("AUDITED")
    attempts = (F.col("o_totalprice") >= 200000).cast("int")
    return _claims(spark, sf_dir).select("o_orderkey", rules.rendered(state, F.col("status")).alias("rendered"), rules.repairable(F.col("status"), state, F.month("o_orderdate"), attempts, F.lit(False), F.lit("POLICY_FACT")).alias("repairable"))


@query("SELECT n_name, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS {s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def coverage_pivot(spark, sf_dir):
    """Grid of cells: A7 A8."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    grid = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").pivot("c_mktsegment", segments).count()
    return grid.select("n_name", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in segments])


@query("""WITH d AS (SELECT c_nationkey AS k, c_custkey, 'FULLY_COVERED' AS status, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer WHERE c_acctbal > 9000)
SELECT n_nationkey, n_name, coalesce(status, 'NOT_STATED') AS status, status IS NOT NULL AS validated, c_custkey FROM nation LEFT JOIN d ON k = n_nationkey AND n = 1""")
def cell_left_join(spark, sf_dir):
    """Every exposure with its first draft: J8 R6."""
    drafts = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", F.lit("FULLY_COVERED").alias("status"))
    return rules.first_of_each(drafts, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "c_custkey")


@query("SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY s_suppkey) AS place FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > 5000 AND c_acctbal > 5000")
def relevant_cells(spark, sf_dir):
    """Cells of wanted exposures in order: J9 J1 J13 P6."""
    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small customer has many cells
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy("c_custkey").agg(F.sort_array(F.collect_list("c_nationkey")).alias("nations"))
    each = wanted.select("nations").distinct().select("nations", F.explode("nations").alias("s_nationkey"))
    offered = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    # cells are put in order once for all that want the same, so only the result has a row for each pair
    cells = each.join(offered, "s_nationkey").groupBy("nations").agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").isNull().alias("last"), "s_suppkey"))).alias("cells"))
    lists = cells.select("nations", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part"), F.transform("cells", lambda c: c["s_suppkey"]).alias("cells"))
    dealt = wanted.withColumn("part", F.pmod(F.hash("c_custkey"), F.lit(tasks)))
    out = dealt.repartition(tasks, "nations", "part").join(lists.repartition(tasks, "nations", "part"), ["nations", "part"]).select("c_custkey", F.posexplode("cells").alias("at", "s_suppkey"))
    return out.select("c_custkey", "s_suppkey", (F.col("at") + 1).cast("long").alias("place"))


_BEFORE = "SELECT o_custkey AS k, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1"
_NOW = "SELECT o_custkey AS k, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1"


def _halves(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    view = lambda c: orders.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("s"))
    return view("o_orderdate < timestamp '1997-01-01'"), view("o_orderdate >= timestamp '1997-01-01'")


@query(f"WITH b AS ({_BEFORE}), w AS ({_NOW}) SELECT w.k, CASE WHEN b.k IS NULL THEN 'new' ELSE 'changed' END AS change FROM w LEFT JOIN b USING (k) WHERE b.k IS NULL OR w.n IS DISTINCT FROM b.n OR w.s IS DISTINCT FROM b.s")
def snapshot_diff(spark, sf_dir):
    """What is new or changed since a snapshot: J14."""
    before, now = _halves(spark, sf_dir)
    return rules.changed(now, before, "k", ["n", "s"])


@query(f"WITH b AS ({_BEFORE}), w AS ({_NOW}) SELECT coalesce(w.k, b.k) AS k, CASE WHEN w.k IS NULL THEN b.n ELSE w.n END AS n, CASE WHEN w.k IS NULL THEN b.s ELSE w.s END AS s, CASE WHEN b.k IS NULL THEN 1 ELSE 0 END AS appended FROM b FULL JOIN w ON b.k = w.k")
def upsert(spark, sf_dir):
    """Old rows replaced, new ones appended: E4 U5."""
    before, now = _halves(spark, sf_dir)
    return rules.upsert(before.withColumn("ord", F.col("k")), now.withColumn("ord", F.col("k")), "k", "ord").select("k", "n", "s", "appended")


@query("SELECT l_orderkey, bool_or(CAST(l_quantity AS INTEGER) % 7 <> coalesce(CASE WHEN p_size < 45 THEN CAST(p_size AS INTEGER) % 7 END, -1)) AS stale FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def stale_keys(spark, sf_dir):
    """Cells that cite an item whose hash is another now: U4 J15 U2 U3."""
    cached = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), F.expr("cast(l_quantity as int) % 7").alias("hash"))
    current = table(spark, sf_dir, "part").where("p_size < 45").select(F.col("p_partkey").alias("item"), F.expr("cast(p_size as int) % 7").alias("hash"))
    return rules.stale(cached, current, "l_orderkey", "item")


@query("""WITH t AS (SELECT DISTINCT p_brand, p_type || '/' || p_size AS term FROM part), b AS (SELECT p_brand, list(term) AS terms FROM t GROUP BY 1)
SELECT x.p_brand AS a, y.p_brand AS b, len(list_intersect(x.terms, y.terms)) AS shared, len(x.terms) + len(y.terms) - 2 * len(list_intersect(x.terms, y.terms)) AS differing FROM b x JOIN b y ON x.p_brand < y.p_brand""")
def symmetric_terms(spark, sf_dir):
    """Terms that two brands share or only one has: J16 E3."""
    terms = table(spark, sf_dir, "part").select("p_brand", F.xxhash64(F.concat_ws("/", "p_type", "p_size")).alias("term")).distinct()
    size = terms.groupBy("p_brand").agg(F.count("*").alias("n"))
    both = terms.select(F.col("p_brand").alias("a"), "term").join(terms.select(F.col("p_brand").alias("b"), "term"), "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    of = lambda c: size.select(F.col("p_brand").alias(c), F.col("n").alias(f"n{c}"))
    pairs = of("a").crossJoin(of("b")).where("a < b").join(both, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))  # a closed list of brands
    return pairs.select("a", "b", "shared", (F.col("na") + F.col("nb") - 2 * F.col("shared")).alias("differing"))


_LINKS = "SELECT c_custkey, string_agg(s_suppkey, ',' ORDER BY s_suppkey) AS linked FROM customer JOIN (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal < 2000) ON c_nationkey = s_nationkey GROUP BY c_custkey"


@query(f"SELECT customer.c_custkey, coalesce(linked, '') AS linked FROM customer LEFT JOIN ({_LINKS}) USING (c_custkey)")
def footnote_links(spark, sf_dir):
    """Items with the notes that have their marker: J2 J3 T3."""
    items = table(spark, sf_dir, "customer").select(F.lit(1).alias("doc"), F.col("c_custkey").alias("id"), F.array("c_nationkey").alias("markers"))
    notes = table(spark, sf_dir, "supplier").where("s_acctbal < 2000").select(F.lit(1).alias("doc"), F.col("s_nationkey").alias("marker"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"))
    shown = lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    return rules.linked(items, notes, "doc", "markers", "ord", shown).select(F.col("id").alias("c_custkey"), "linked")


@query("SELECT s_suppkey, count(c_custkey) AS n_items, min(c_custkey) AS first_item FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > 0 GROUP BY s_suppkey")
def reverse_links(spark, sf_dir):
    """Notes with the items that link to them: J4 X2."""
    marked = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"), F.min("c_custkey").alias("first"))
    notes = table(spark, sf_dir, "supplier").join(marked, F.col("c_nationkey") == F.col("s_nationkey"), "left")  # items are summed up by marker first: no pairs
    return notes.groupBy("s_suppkey").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.min("first").alias("first_item"))


@query("SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_action_state(spark, sf_dir):
    """State from the last event of an append-only log: R13 K2 S6."""
    return rules.latest(table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_map_lookup(spark, sf_dir):
    """Look-ups in JSON payloads: C3 C1 S6."""
    k = F.try_element_at(F.from_json("props", "map<string,bigint>"), F.lit("k"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", k.alias("k")).agg(F.count("*").alias("n"))


_AXIS = "SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0 AS t FROM events"


def _axis(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1000000.0D").alias("at"))


@query(f"""WITH e AS ({_AXIS}), c AS (SELECT * FROM e WHERE event_type IN ('click', 'view', 'error')), s AS (SELECT event_id AS step, user_id, t AS s0, t + value * 200 AS s1 FROM e WHERE event_type IN ('signup', 'purchase'))
SELECT event_id, step FROM (SELECT c.event_id, step, row_number() OVER (PARTITION BY c.event_id ORDER BY s0 DESC NULLS LAST, step DESC) AS n FROM c LEFT JOIN s ON c.user_id = s.user_id AND t >= s0 AND t <= s1 + 0.5) WHERE n = 1""")
def stage_of_call(spark, sf_dir):
    """The step that a call falls into, the one that starts last: J17."""
    axis = _axis(spark, sf_dir)
    calls = axis.where("event_type in ('click', 'view', 'error')").select("event_id", "user_id", "at")
    steps = axis.where("event_type in ('signup', 'purchase')").select(F.col("event_id").alias("step"), "user_id", F.col("at").alias("s0"), (F.col("at") + F.col("value") * 200).alias("s1"))
    return joins.within_latest(calls, steps, "user_id", "event_id", "at", "s0", "s1", "step", width=20000.0).select("event_id", "step")


@query(f"WITH e AS (SELECT event_id, user_id, t AS s0, t + value * 100 AS s1 FROM ({_AXIS})) SELECT a.event_id FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_id <> a.event_id AND b.s0 < a.s1 AND a.s0 < b.s1)")
def overlapping_calls(spark, sf_dir):
    """Calls that overlap another of their run: J18."""
    spans = _axis(spark, sf_dir).select("event_id", "user_id", F.col("at").alias("s0"), (F.col("at") + F.col("value") * 100).alias("s1"))
    return joins.overlapping(spans, "user_id", "event_id", "s0", "s1", width=10000.0)


@query("""SELECT user_id, count(*) AS n_calls, count(*) FILTER (event_type = 'error') AS n_errors, sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type <> 'error') AS tokens, sum(CAST(round(value * 100) AS BIGINT)) AS latency, count(DISTINCT event_type) AS n_prompts FROM events GROUP BY user_id""")
def call_profile(spark, sf_dir):
    """Sums over calls of a run: A11 X19 K4."""
    units = F.round(F.col("value") * 100).cast("long")
    ok = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_calls"), F.count_if(~ok).alias("n_errors"), F.sum(F.when(ok, units)).alias("tokens"), F.sum(units).alias("latency"), F.countDistinct("event_type").alias("n_prompts"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def slowest_step(spark, sf_dir):
    """The slowest step of a run, the first of equals: A12."""
    return ordered.quota(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), "event_id"], 1, "n").select("user_id", "event_id", "value")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT DISTINCT s_suppkey // 2 FROM supplier WHERE s_suppkey > 0)""")
def leaf_steps(spark, sf_dir):
    """Steps that are no other step's parent: A12 O12."""
    s = table(spark, sf_dir, "supplier")
    return s.join(s.where("s_suppkey > 0").select(F.expr("s_suppkey div 2").alias("s_suppkey")).distinct(), "s_suppkey", "left_anti").select("s_suppkey", "s_name")


@query("WITH RECURSIVE d(k, p, n) AS (SELECT s_suppkey, s_suppkey // 2, 0 FROM supplier UNION ALL SELECT d.k, s.s_suppkey // 2, n + 1 FROM d JOIN supplier s ON s.s_suppkey = d.p WHERE d.p > 0 AND n < 5) SELECT k, CAST(max(n) AS INTEGER) AS depth FROM d GROUP BY k")
def step_depth(spark, sf_dir):
    """Depth of a step along its parents, five at most, by as many joins: O12."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.expr("s_suppkey div 2").alias("p"))
    parents = s.select(F.col("k").alias("p"), F.col("p").alias("up"))
    out = s.withColumn("depth", F.lit(0))
    for _ in range(5):
        out = out.join(parents, "p", "left").select("k", F.when(F.col("p") > 0, F.coalesce("up", F.lit(0))).otherwise(0).alias("p"), (F.col("depth") + F.when((F.col("p") > 0) & F.col("up").isNotNull(), 1).otherwise(0)).alias("depth"))
    return out.select("k", "depth")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS calls FROM events")
def nested_calls(spark, sf_dir):
    """Calls of a step and of all inside it, where every event of a user is inside the one before: K4 X19."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.lag("event_id").over(w).alias("parent"), F.lit(0.0).alias("seconds"), F.lit(1).cast("long").alias("calls"))
    return rules.rolled_up(steps).select(F.col("step").alias("event_id"), "calls")


@query("SELECT l_suppkey, l_partkey, l_orderkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS place FROM lineitem WHERE l_quantity < 45) WHERE place <= 8")
def quota_topn(spark, sf_dir):
    """The first eight of a category behind a filter: O15 T5 T7 O9."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity < 45")
    return ordered.quota(rows, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_linenumber"], 8).select("l_suppkey", "l_partkey", "l_orderkey", "place")


@query("""SELECT l_suppkey, count(*) FILTER (n <= 10) AS n_kept, count(*) FILTER (n > 10) AS n_cut, min(b) AS best FROM (SELECT l_suppkey, b, row_number() OVER (PARTITION BY l_suppkey ORDER BY b, l_orderkey, l_partkey, l_linenumber) AS n
 FROM (SELECT *, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 0 WHEN l_returnflag = 'N' THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE 3 END AS b FROM lineitem)) GROUP BY l_suppkey""")
def overflow_routing(spark, sf_dir):
    """Stable rank buckets; the first ten are kept, the rest is routed: O9 O16."""
    bucket = F.when(F.expr("l_returnflag = 'N' and l_linestatus = 'O'"), 0).when(F.expr("l_returnflag = 'N'"), 1).when(F.expr("l_returnflag = 'R'"), 2).otherwise(3)
    rows = ordered.numbered(table(spark, sf_dir, "lineitem").withColumn("b", bucket), ["l_suppkey"], ["b", "l_orderkey", "l_partkey", "l_linenumber"], "n")
    return rows.groupBy("l_suppkey").agg(F.count_if(F.col("n") <= 10).alias("n_kept"), F.count_if(F.col("n") > 10).alias("n_cut"), F.min("b").alias("best"))


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events")
def forward_fill(spark, sf_dir):
    """The last heading before each row: O8."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("own"))
    return ordered.filled(rows, ["user_id"], ["event_id"], "own", "heading").select("user_id", "event_id", "heading")


@query("SELECT l_partkey, l_orderkey, l_linenumber, p_size FROM (SELECT l_partkey, l_orderkey, l_linenumber, CAST(round(l_extendedprice / l_quantity / 100) AS INTEGER) AS unit FROM lineitem) JOIN (SELECT DISTINCT p_size FROM part) ON abs(unit - p_size) <= 0.005 * greatest(abs(unit), abs(p_size))")
def tolerant_price_match(spark, sf_dir):
    """Numbers that are equal within half a percent, by logarithmic buckets: N5 X4."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / F.col("l_quantity") / 100).cast("int").alias("unit"))
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    return joins.tolerant(lines, sizes, "unit", "p_size").select("l_partkey", "l_orderkey", "l_linenumber", "p_size")


@query("""WITH e AS (SELECT l_orderkey, list(DISTINCT CAST(l_quantity AS DOUBLE)) AS months FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN months IS NULL THEN 'FAIL_MISSING' WHEN len([m FOR m IN months IF abs(m - y * 12) <= 0.005 * greatest(m, y * 12)]) > 0 THEN 'PASS' ELSE 'FAIL_CONTRADICTED' END AS result FROM (SELECT o_orderkey, CAST(o_custkey % 5 AS DOUBLE) AS y FROM orders) LEFT JOIN e ON l_orderkey = o_orderkey""")
def number_check_status(spark, sf_dir):
    """Claimed years against evidence in months: N4 N5 N6 N7."""
    made = lambda v, unit: F.struct(v.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit("").alias("raw"))
    evidence = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(made(F.col("l_quantity"), "MONTHS")).alias("e"))
    orders = table(spark, sf_dir, "orders").join(evidence, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<struct<value:double,unit:string,raw:string>>")
    return orders.select("o_orderkey", q.number_check(F.array(made(F.expr("o_custkey % 5"), "YEARS")), F.coalesce("e", none)).alias("result"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN false WHEN o_orderpriority = '5-LOW' THEN true ELSE (o_totalprice > 100000 AND o_totalprice <= 200000 * (1 + 1e-9)) OR o_totalprice >= 400000 * (1 - 1e-9) END AS available FROM orders")
def range_contains(spark, sf_dir):
    """Availability at an amount over ranges with open ends: N9 N10 A10."""
    made = lambda low, high, le: F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.lit(le).alias("low_ex"), F.lit(False).alias("high_ex"))
    ranges = F.array(made(100000, 200000, True), made(400000, "inf", False))
    return table(spark, sf_dir, "orders").select("o_orderkey", q.available(F.col("o_orderstatus") != "F", F.col("o_orderpriority") != "5-LOW", ranges, F.col("o_totalprice")).alias("available"))


@query("""SELECT o_orderkey, CASE WHEN length(w) <= 3 THEN w ELSE regexp_replace(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '([0-9]{2})', '\\1,', 'g')), '^,', '') || ',' || right(w, 3) END || CASE WHEN f = '00' THEN '' ELSE '.' || regexp_replace(f, '0+$', '') END AS shown
 FROM (SELECT o_orderkey, split_part(printf('%.2f', o_totalprice), '.', 1) AS w, split_part(printf('%.2f', o_totalprice), '.', 2) AS f FROM orders)""")
def indian_grouping(spark, sf_dir):
    """Amounts with Indian digit groups: N11."""
    return table(spark, sf_dir, "orders").select("o_orderkey", q.grouped_indian(F.col("o_totalprice")).alias("shown"))


@query("SELECT event_id, 'RUN-' || strftime(ts, '%Y%m%d-%H%M%S') || '-' || lpad(lower(to_hex(event_id % 65536)), 4, '0') AS run_id, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) > 604800000000 AS stale FROM events")
def run_ids(spark, sf_dir):
    """Run ids from timestamps and cache age: N13 U6."""
    rid = F.concat(F.lit("RUN-"), F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("-"), F.lpad(F.lower(F.hex(F.expr("event_id % 65536"))), 4, "0"))
    age = F.expr("timestampdiff(MICROSECOND, ts, timestamp_ntz'2024-02-01 00:00:00')")
    return table(spark, sf_dir, "events").select("event_id", rid.alias("run_id"), (age > 7 * 86400 * 1000000).alias("stale"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice) - 1) // 4 AS chunk FROM lineitem")
def chunks(spark, sf_dir):
    """Rows in groups of four, in order: X18."""
    rows = ordered.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice"], "n")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.floor((F.col("n") - 1) / 4).alias("chunk"))


@query("SELECT a.l_orderkey, a.l_linestatus, a.l_linenumber, a.l_partkey, count(DISTINCT b.l_partkey) AS siblings FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = b.l_linestatus GROUP BY ALL")
def sibling_rows(spark, sf_dir):
    """Items with how many different ones share their row: J6 J7 J23."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_linenumber", "l_partkey")
    size = rows.groupBy("l_orderkey", "l_linestatus").agg(F.countDistinct("l_partkey").alias("siblings"))
    return rows.distinct().join(size, ["l_orderkey", "l_linestatus"]).select("l_orderkey", "l_linestatus", "l_linenumber", "l_partkey", "siblings")


@query(f"SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders JOIN ({_ITEMS_SQL}) ON l_orderkey = o_orderkey WHERE kind = 'fail' AND o_orderstatus <> 'F') GROUP BY o_custkey")
def blocking_ids(spark, sf_dir):
    """Ids of blocking statements in order: A14."""
    fails = _line_items(spark, sf_dir).where("kind = 'fail'").select("l_orderkey").distinct()
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").join(fails, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("ids"))


@query("""WITH n AS (SELECT c_custkey AS k, c_nationkey % 3 AS status, CAST(floor(c_acctbal) AS BIGINT) % 5 AS number FROM customer), p AS (SELECT c_custkey AS k, c_nationkey % 4 AS status, CAST(floor(c_acctbal) AS BIGINT) % 5 AS number, c_custkey % 7 AS attempts FROM customer WHERE c_custkey % 2 = 0)
SELECT n.k, n.status, n.number, CASE WHEN n.status = p.status AND n.number = p.number THEN p.attempts ELSE 0 END AS attempts, coalesce(n.status = p.status AND n.number = p.number, false) AS carried FROM n LEFT JOIN p USING (k)""")
def result_carry_over(spark, sf_dir):
    """Results equal to the previous ones keep their history: R15."""
    c = table(spark, sf_dir, "customer").where("c_acctbal is not null")
    number = F.expr("cast(floor(c_acctbal) as bigint) % 5")
    now = c.select(F.col("c_custkey").alias("k"), F.expr("cast(c_nationkey % 3 as int)").alias("status"), number.alias("number"), F.lit(0).cast("long").alias("attempts"))
    before = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.expr("cast(c_nationkey % 4 as int)").alias("status"), number.alias("number"), F.expr("c_custkey % 7").alias("attempts"))
    return rules.carried_over(now, before, "k", ["status", "number"], ["attempts"])


