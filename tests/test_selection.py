"""Selection, points, retrieval and predicates on small tables."""

from pyspark.sql import functions as F

from veridock.functions import predicates as p
from veridock.functions import quantity as q
from veridock.operators import selection as s


def test_selection(spark):
    sel = spark.createDataFrame([("r1", ["P", "Q"], "P", "Gold", ["Wellness Pack"], ["X1"], ["E1"], ["q"]), ("r2", ["P"], "Z", "Tin", ["Nothing"], ["X9"], ["E2", "E3", "E9"], [])], "run_id string, compared_policy_ids array<string>, selected_policy_id string, selected_variant string, required_addons array<string>, relevant_exposure_ids array<string>, supporting_evidence_ids array<string>, supporting_quotes array<string>")
    compared = spark.createDataFrame([("r1", "Q"), ("r1", "P"), ("r2", "P"), ("r2", "Q")], "run_id string, policy_id string")
    exposures = spark.createDataFrame([("r1", "X1"), ("r2", "X1")], "run_id string, exposure_id string")
    ev = spark.createDataFrame([("E1", "P", True, "s", None, "The Wellness  Pack™ pays"), ("E2", "R", True, "s", None, "t"), ("E3", "Q", False, "s", None, "t")], "evidence_id string, document_id string, citable boolean, section string, row_label string, text string")
    ev = ev.withColumn("text", F.regexp_replace("text", "™", ""))
    variants = spark.createDataFrame([("P", "G old")], "policy_id string, variant string")
    got = {(r.run_id, r.error) for r in s.selection_errors(sel, compared, exposures, ev, variants).collect()}
    assert got == {("r2", e) for e in ("compared set differs", "selected policy not compared", "E2 is of another policy", "E3 is not citable", "E9 does not exist", "no evidence of the selected policy", "no quote", "unknown exposure X9", "unknown variant", "add-on not in evidence: Nothing")}
    over = spark.createDataFrame([("r1", "Q", "client asked"), ("r2", "Q", "why")], "run_id string, policy_id string, reason string")
    out = {r.run_id: r for r in s.overridden(sel.withColumn("decided_by", F.lit("llm")), over).collect()}
    assert (out["r1"].selected_policy_id, out["r1"].selected_variant, out["r1"].required_addons, out["r1"].decided_by) == ("Q", None, [], "advisor")
    assert (out["r2"].selected_policy_id, out["r2"].overridden) == ("Z", False)
    decks = spark.createDataFrame([("r1", "P", "gold"), ("r2", "P", None), ("r3", "P", None)], "run_id string, policy_id string, variant string")
    assert {(r.run_id, r.error) for r in s.deck_errors(decks, sel).collect()} == {("r2", "other policy"), ("r3", "no selection")}


def test_points(spark):
    rows = [("p1", "M1", "We run 40 centres", "We run 40 centres, exactly", "It matters to 500 staff", ["exactly"], ["500 staff"], []), ("p2", "M1", "We run 40 centres", "We run 40 centres exactly", "x", [], ["f"], []), ("p3", "M2", None, "t", "x", [], ["f"], []), ("p4", "M3", "We run 40 centres", "We run 45 centres with Bluecare", "for 9 people", ["exactly"], [], ["X9"])]
    df = spark.createDataFrame(rows, "point_id string, record_id string, record_fact string, capability_text string, link_text string, required array<string>, basis_values array<string>, unknown_exposures array<string>")
    num = lambda c: q.quantities(F.coalesce(c, F.lit("")), False)
    df = df.withColumn("capability_numbers", num(F.col("capability_text"))).withColumn("record_numbers", num(F.col("record_fact"))).withColumn("link_numbers", num(F.col("link_text"))).withColumn("basis_numbers", num(F.array_join("basis_values", " ")))
    got = {r.point_id: (r.problems, r.kept) for r in s.point_problems(df, {"P": ["bluecare"]}).collect()}
    assert got["p1"] == ([], True) and got["p2"] == ([], False) and got["p3"] == (["not a documented capability"], False)
    assert got["p4"][0] == ["changes a number", "keep exactly", "names a product", "needs company facts", "unknown exposures", "number not in the facts"]


def test_retrieval(spark):
    ev = spark.createDataFrame([("e1", "P", 0, "Cover", None, "room rent limit", True, ["n1"]), ("e2", "P", 1, "Cover", None, "room only", True, []), ("e3", "Q", 2, "", None, "room rent", True, []), ("e4", "P", 3, "", None, "room rent limit", False, []), ("n1", "P", 4, "", None, "note", True, []), ("n2", "P", 5, "", None, "nothing", True, [])], "evidence_id string, document_id string, ord int, section string, row_label string, text string, citable boolean, linked_footnote_ids array<string>")
    asked = spark.createDataFrame([("c", "P", "The room rent")], "query_id string, policy_id string, text string")
    assert [r.evidence_id for r in s.retrieved(asked, ev, 1).orderBy("ord").collect()] == ["e1", "n1"]
    assert [r.evidence_id for r in s.retrieved(asked, ev).orderBy("ord").collect()] == ["e1", "e2", "n1"]
    cells = spark.createDataFrame([("P", "m1", "A"), ("P", "m2", "B"), ("Q", "m3", "A")], "policy_id string, match_id string, exposure_id string")
    claims = spark.createDataFrame([("c1", "P", "m1"), ("c2", "P", None), ("c3", "P", "zz")], "claim_id string, policy_id string, match_id string")
    said = spark.createDataFrame([("c1", "B"), ("c2", "B"), ("c3", "A")], "id string, exposure_id string")
    assert {(r.claim_id, r.match_id) for r in s.cells_of(claims, cells, said).collect()} == {("c1", "m1"), ("c2", "m2"), ("c3", "m1")}


def test_small_operators(spark):
    claims = spark.createDataFrame([("a", "old", "AUDITED"), ("b", "x", "AUDITED")], "claim_id string, text string, state string")
    edits = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "claim_id string, text string, at int")
    assert {r.claim_id: (r.text, r.state, r.edited) for r in s.edited(claims, edits).collect()} == {"a": ("2", "DIRTY", True), "b": ("x", "AUDITED", False)}
    cells = spark.createDataFrame([("r", 1, 1, "SUBLIMIT", "A limit"), ("r", 1, 2, "WAITING", "A wait"), ("r", 2, 1, "WAITING", "a  WAIT"), ("r", 3, 1, "WAITING", "Old"), ("r", 3, 2, "OTHER", "z")], "run_id string, row int, place int, kind string, text string")
    there = spark.createDataFrame([("r", "old")], "run_id string, text string")
    assert [(r.kind, r.text) for r in s.limitation_topup(cells, ["WAITING", "SUBLIMIT"], 2, there).orderBy("ord").collect()] == [("WAITING", "A wait"), ("SUBLIMIT", "A limit")]
    spans = spark.createDataFrame([(1, 1.0, 10.0, 5.0, 12.0, "line", False), (1, 1.0, 30.0, 5.0, 32.0, "far", False), (1, 6.0, 13.0, 7.0, 14.0, "1", True), (1, 90.0, 10.0, 95.0, 12.0, "out", False)], "page int, x0 double, y0 double, x1 double, y1 double, text string, superscript boolean")
    regions = spark.createDataFrame([(1, 7, 0.0, 0.0, 50.0, 50.0)], "page int, region_id int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.text, r.line_y) for r in s.in_region(spans, regions).collect()} == {("line", 11.0), ("far", 31.0), ("1", 11.0)}
    rows = spark.createDataFrame([("g", "a"), ("g", "a"), ("g", "b")], "g string, k string")
    assert {(r.g, r.k, r.n) for r in s.limits_kept(rows, "g", "k", {"a": (0, 1), "b": (1, 1), "c": (1, 2)}).collect()} == {("g", "a", 2), ("g", "c", 0)}
    ids = spark.createDataFrame([("x.pdf", "home", "abcdef99"), ("x.pdf", "else", "abcdef99")], "n string, f string, s string").select(s.document_id(F.col("n"), F.col("f"), F.col("s"), {"x.pdf": "POL-X"}, "home")).collect()
    assert [r[0] for r in ids] == ["POL-X", "POL-UPL-ABCDEF"]
    items = spark.createDataFrame([("r1", "fail"), ("r1", "review"), ("r2", "review"), ("r3", "none")], "run_id string, kind string")
    assert {r.run_id: r.message for r in s.attention(items).collect()} == {"r1": "1 statement(s) must be changed", "r2": "1 item(s) to review", "r3": "Ready"}


def test_predicates(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(p.shows_benefit(F.lit("pays rent"), F.lit("Cover"), F.lit("BASE"), F.lit("X")))
    assert not one(p.shows_benefit(F.lit("10% discount"), F.lit("Cover"), F.lit("BASE"), F.lit("X")))
    assert one(p.shows_benefit(F.lit("10% discount"), F.lit("Cover"), F.lit("BASE"), F.lit("EXP-WELLNESS")))
    assert not one(p.shows_benefit(F.lit("x"), F.lit("About us"), F.lit("BASE"), F.lit("X")))
    assert one(p.defines_benefit(F.lit("60 Days."), F.lit("Pre-hospitalisation"))) and not one(p.defines_benefit(F.lit("60 Days."), F.lit("Wait")))
    assert one(p.defines_benefit(F.lit("Up to Sum Insured"), F.lit(""))) and not one(p.defines_benefit(F.lit("Up to Sum Insured, 2 a year"), F.lit("")))
    assert one(p.states_figure(F.lit("size"), F.lit("1,200"))) and not one(p.states_figure(F.lit("size"), F.lit("over 1,000")))
    assert one(p.states_money(F.lit("₹5 crore"))) and not one(p.states_money(F.lit("crores")))
    assert one(p.priced_in_context(F.lit("age 35, family floater, sum insured 5L"))) and not one(p.priced_in_context(F.lit("age 35")))
    assert one(p.overstatements(F.lit("Covers rooms always"), F.lit("covers rooms"))) == ["always"] and one(p.overstatements(F.lit("Covers rooms always"), F.lit("rooms, always"))) == []
    assert one(p.missing_restriction(F.lit("Only after a wait of years. Fine words here."), F.lit("Covers rooms"), F.lit("Covers rooms"))) == "Only after a wait of years."
    assert one(p.complete_sentence(F.lit("This is a whole sentence."))) and not one(p.complete_sentence(F.lit("Which is not a sentence at all.")))
