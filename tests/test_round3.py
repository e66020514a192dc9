"""Queries against their SQL on odd tables: ids that repeat, nulls, crowded places."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_queries import plain
from veridock.operators import ordered


@pytest.fixture
def equal(spark, tmp_path):
    """Writes tables (name: (schema, rows)), and holds a query against its SQL on them."""

    def check(query, tables):
        con = duckdb.connect()
        for name, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        df, rel = entry.queries()[query](spark, str(tmp_path)), con.sql(entry.oracle_sql()[query])
        got = sorted(repr([plain(r[c]) for c in rel.columns]) for r in df.collect())
        assert got == sorted(repr([plain(x) for x in r]) for r in rel.fetchall())
        return got

    return check


def test_quotes_by_lang_with_ids_that_repeat(equal):
    a, b = "one two three four five six", "seven eight nine"
    docs = [(1, f"So {a} now.", "en"), (1, f"So {a} now.", "en"), (1, b, "de"), (2, f"{b}, {a}", None), (2, "none", "en"), (None, a, "en"), (3, None, "de"), (4, "none", "fr")]
    items = [(1, a), (2, b), (2, a), (None, b), (3, None)]
    assert len(equal("quote_match_by_lang", {"documents": ("doc_id long, text string, lang string", docs), "benchmark": ("item_id long, text string", items)})) == 4


NATIONS = ("c_custkey long, c_nationkey int, c_acctbal double", [(1, 1, 9000.0), (2, 1, 6000.0), (3, 2, 7000.0), (4, None, 8000.0), (5, 3, 5500.0), (6, 1, -5.0), (7, 2, None)])
SELLERS = ("s_suppkey long, s_nationkey int, s_acctbal double", [(12, 1, 6000.0), (2, 1, 1000.0), (9, 1, 500.0), (3, 2, 9000.0), (4, None, 8000.0), (5, 4, 100.0), (6, 1, 7000.0), (10, 1, -1.0)])


def summed_up_first(spark, query, folder):
    """No join of the plan reads rows as they are on both sides: a group's rows meet those of the other side once, not in pairs."""
    plan = entry.queries()[query](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()
    return "Aggregate" in plan[plan.rindex("Join") :]


@pytest.mark.parametrize("query", ["reverse_links", "footnote_links", "relevant_cells"])
def test_many_to_many_without_pairs(spark, equal, tmp_path, query):
    equal(query, {"customer": NATIONS, "supplier": SELLERS})
    assert summed_up_first(spark, query, tmp_path)


def test_clusters_are_looked_up_without_a_shuffle_of_the_rows(spark):
    """Values by cells, so that what is joined to the rows is small enough to be sent to them; odd values have theirs too."""
    rows = [(float(i % 500) * 0.25, i) for i in range(2000)] + [(v, -1) for v in (float("inf"), float("-inf"), 1e300, 1e300 * 1.0000000000000002, 1e17, 1e17 + 16, 1e17 + 32, -0.0)]
    df = spark.createDataFrame(rows, "y double, i int")
    got = ordered.clustered(df, [], "y", 1.1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    first, n, want = None, 0, {}
    for v in sorted({v for v, _ in rows}):
        if first is None or v - first >= 1.1:
            first, n = v, n + 1
        want[v] = n
    assert {r.y: r.cluster for r in got.collect()} == want and got.count() == len(rows)


@pytest.mark.parametrize("at_once", [7, 1000])
def test_headings_meet_no_more_blocks_where_there_are_more(spark, monkeypatch, at_once):
    """Denser boxes are looked up in lower cells, a block in one cell, a crowded cell in parts; odd places are left out."""
    from veridock.operators import joins

    monkeypatch.setattr(joins, "CROWD", 4)
    monkeypatch.setattr(joins, "AT_ONCE", at_once)
    heads = spark.range(4000).selectExpr("1 as page", "id as hid", "double(id % 50) as hx0", "double(id % 50 + 1 + id % 7) as hx1", "double(id * 0.25) as bottom")
    reaches = [joins._fitting_reach(heads.where(f"hid % {k} = 0"), "page", 64.0, 512.0) for k in (1, 7, 49)]
    assert reaches[0] <= 2.0 and reaches == sorted(set(reaches))
    same = heads.where("hid < 50").withColumn("bottom", F.lit(5.0))
    assert joins._fitting_reach(same, "page", 64.0, 512.0) > 0
    blocks = spark.range(300).selectExpr("1 as page", "id", "double(id % 40) as x0", "double(id % 40 + 1 + id % 5) + if(id = 7, 1e15, 0) as x1", "id * 3.5D as top")
    odd = spark.createDataFrame([(1, 900, 0.0, 5.0, float("nan")), (1, 901, 0.0, 5.0, float("inf")), (1, 902, 0.0, float("inf"), 1.0), (None, 903, 0.0, 5.0, 1.0)], "page int, id long, x0 double, x1 double, top double")
    got = {r.id: r.hid for r in joins.closest_above(blocks.unionByName(odd), heads.union(same.selectExpr("page", "hid", "hx0", "hx1", "double('inf')")), width=50.0, height=500.0).collect()}
    h = [(r.bottom, r.hid, r.hx0, r.hx1) for r in heads.collect()]
    want = {r.id: min(((abs(b - r.top), i) for b, i, a, z in h if b >= r.top - 2 and a < r.x1 and z > r.x0), default=(0, None))[1] for r in blocks.collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


@pytest.mark.parametrize("whole", [200_000, 3])
def test_calls_are_summed_up_in_one_shuffle(spark, monkeypatch, whole):
    """Whole runs at once, and longer runs by joins, give the same: chains, a tree, a circle with what is below, parents of another run."""
    from veridock.operators import rules

    monkeypatch.setattr(rules, "WHOLE", whole)
    monkeypatch.setattr(rules, "AT_ONCE", 5)
    rows = [(r, s, s - 1 if s else None, 0.0, 1) for r in (1, 2) for s in range(9)] + [(3, 0, None, 0.5, 2), (3, 1, 0, 0.0, 3), (3, 2, 0, 0.0, 4), (3, 5, 8, 0.0, 1)]
    rows += [(4, 1, 2, 0.0, 1), (4, 2, 1, 0.0, 1), (4, 3, 2, 0.0, 1), (4, 4, None, 0.0, 7), (5, 1, None, 0.0, 1), (5, 2, 1, 0.0, 1)]
    got = rules.rolled_up(spark.createDataFrame(rows, "run_id long, step long, parent long, seconds double, calls long"))
    if whole > 9:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = {(r, s): 9 - s for r in (1, 2) for s in range(9)} | {(3, 0): 9, (3, 1): 3, (3, 2): 4, (3, 5): 1, (4, 1): 1, (4, 2): 1, (4, 3): 1, (4, 4): 7, (5, 1): 2, (5, 2): 1}
    assert sorted((r.run_id, r.step, r.calls) for r in got.collect()) == sorted((*k, v) for k, v in want.items())


def test_numbers_are_asked_what_they_need(spark):
    """Registers are searched for where their sign is, and patterns that Spark compiles for each row only where a text holds the mark."""
    from veridock.functions import folds, quantity

    rows = [(1, "Up to INR 5,000 after 24 months, with 10% co-pay"), (2, "Call 1800 266 7780 within 7 days"), (3, "a 5 days\u0001b 3 days"), (4, "Zone 3, aged 30, form ABC/12/34 of 2 lakh")]
    df = spark.createDataFrame(rows, "i int, t string").select("i", quantity.quantities(F.col("t")).alias("q"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert quantity._REGISTER_SIGN in plan and folds._MARK in plan
    got = {r.i: [(x.value, x.unit) for x in r.q] for r in df.collect()}
    assert got == {1: [(5000.0, "INR"), (24.0, "MONTHS"), (10.0, "PERCENT")], 2: [(7.0, "DAYS")], 3: [(5.0, "DAYS"), (3.0, "DAYS")], 4: [(30.0, "YEARS"), (200000.0, "INR")]}


@pytest.mark.parametrize("few", [100_000, 0])
def test_quotes_go_to_the_views(spark, monkeypatch, few):
    """Words of views are shuffled only for more quotes than are sent; passages of one id are looked up one by one."""
    from veridock.operators import quoting

    monkeypatch.setattr(quoting, "FEW", few)
    texts = [(1, "so one two three four five six."), (1, "so one two three four five six."), (2, "Other words, but not these seven words at all"), (3, "x-ray (7), not more"), (None, "one two")]
    passages = [(1, "one two three four five"), (1, "words but none of these"), (1, "but not these seven words"), (2, "ray"), (2, "more"), (3, "two"), (4, "ivory")]
    got = quoting.quotes(spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(passages, "p int, quote string"), "t", "text", "p", "quote")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert few == 0 or plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.t or 0, r.p) for r in got.collect()) == [(0, 3), (1, 1), (1, 3), (2, 1), (3, 2)]


def test_runs_of_letters_are_those_of_the_normal_form(spark):
    """Whatever character stands between letters, and whatever the normal form drops, joins or writes anew."""
    import random
    import re

    import pyarrow as pa
    from veridock.functions import textnorm as t
    from veridock.operators import quoting

    dice = random.Random(3)
    pieces = ["Care", "rs", "Rs.", "inr", "rupees", "5", "12", "%", "*", "(7)", " ", " ", "\n", " ", "`", "�", "™", "ß", "ẞ", "İ", "K", "é", "st", "t itanium+", "platinum +", "₹", "’", "–", "_", "!", "x", "[`]", "optima secure +"]
    mixed = ["".join(dice.choice(pieces) for _ in range(dice.randrange(1, 14))) for _ in range(20_000)]
    texts = [f"xxb{chr(c)}ycc dd" for c in range(0x10000) if not 0xD800 <= c < 0xE000] + mixed
    df = spark.createDataFrame(pa.table({"i": list(range(len(texts))), "s": texts}))
    norm = {r.i: re.findall("[a-z]+", r.n) for r in df.select("i", t.normalised("s").alias("n")).collect()}
    windows = lambda runs: {tuple(runs[a:z]) for a in range(len(runs)) for z in range(a + 1, min(a + quoting.TOGETHER, len(runs)) + 1)}
    for i, got in enumerate(quoting.letter_runs(pa.array(texts)).to_pylist()):
        want = {w for w in windows(norm[i]) if not any(re.search(t.MADE, r) for r in w)}
        assert want <= windows([r.decode() for r in got if r]), (texts[i], norm[i], got)


def test_only_texts_that_may_quote_are_brought_into_the_normal_form(spark, monkeypatch):
    """Few of the texts are stored, bytes that are no UTF-8 and odd characters hide no quote, and a quote that tells nothing lets all in."""
    from veridock.functions import textnorm as t
    from veridock.operators import quoting

    read = []
    monkeypatch.setattr(quoting, "views", lambda *a, f=quoting.views, **b: read.append(f(*a, **b)) or read[-1])
    odd = ["", "Er mußte KLA`REN Bescheid2 geben*, bald", "so Er MUSSTE (7) klaren bescheid geben", "Er musste klarens Bescheid geben", "rs. 5 mean INR 5 everywhere else", "bescheid geben", "Optima secure + and t itanium+ covers", "titanium covers and cover"]
    rows = [(i, x) for i, x in enumerate(odd * 3 + [f"nothing of it {i}" for i in range(500)])]
    asked = [(1, "er musste klaren bescheid"), (2, "5 mean ₹5 everywhere"), (3, "optima secure+ and titanium+ covers"), (4, "“Nothing of IT 77”"), (5, "titanium covers and")]
    texts = spark.createDataFrame(rows, "t int, text string").unionByName(spark.sql("select -1 as t, cast(concat(unhex('ff'), 'er musste klaren', unhex('c3'), ' bescheid') as string) as text"))
    passages = spark.createDataFrame(asked, "p int, quote string").where("p <> 4")
    for more, most in ((passages, 30), (passages.union(spark.sql("select 6, 'it'")), len(rows) + 1)):
        want = texts.crossJoin(more).where(t.quoted_in("quote", "text")).select("t", "p")
        got = quoting.quotes(texts, more, "t", "text", "p", "quote")
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() >= 9
        assert read[-1].count() <= most
    assert quoting.quotes(texts, passages.where("p > 9"), "t", "text", "p", "quote").count() == 0 == read[-1].count()
