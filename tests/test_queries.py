"""Every query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df, rel = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)

    def rows(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted([repr(plain(r[i])) for i in order] for r in data)

    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_greedy_statements_match_a_fold_by_the_rule(spark):
    import re

    from veridock.functions.predicates import OVERLAP_STOP_WORDS
    from veridock.operators import joins, ordered
    from veridock.session import scratch

    texts = ["red green blue", "red yellow black", "Red  green blue.", "日本語の文章です。これは長い文章の例として書かれました", "前置き 日本語の文章です。これは長い文章の例として書かれました", "вот", "вот", "да", "one two three four five", "one two three four", "", " . "]
    texts += [" ".join(f"w{(i * k) % 11}" for k in range(1, 11)) for i in range(1, 11)]

    def same(x, y):
        a, b = (re.sub(r"\s+", " ", s.lower()).strip(" .") for s in (x, y))
        u, v = ({w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) > 1} - set(OVERLAP_STOP_WORDS) for s in (x, y))
        return a == b or (min(len(a), len(b)) > 20 and (a in b or b in a)) or (bool(u and v) and len(u & v) / len(u | v) >= 0.8)

    kept = []
    for i, s in enumerate(texts):
        if not any(same(s, texts[k]) for k in kept):
            kept.append(i)
    scratch(spark)
    items = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    pairs = joins.duplicates(items, "ord", "text")
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for b in range(len(texts)) for a in range(b) if same(texts[a], texts[b])}
    assert sorted(r["ord"] for r in ordered.greedy_conflicts(items, pairs).collect()) == kept
