"""Cases of the evidence model: cells, retrieval, selections, decks, edits, layout, sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veridock.functions import hashing as h
from veridock.functions import predicates as p
from veridock.functions import prompts
from veridock.functions import quantity as q
from veridock.functions import textnorm as t
from veridock.operators import audit as au
from veridock.operators import claims as cl
from veridock.operators import joins, ordered, rules
from veridock.operators import selection as s
from tests.cases.golden import Cases, back, bare, golden, joined
from tests.cases.readings import ALIASES
from veridock.session import scratch
from veridock.sources import evidence as ev
from veridock.sources import sinks

_LIMIT = "array<struct<kind:string,ids:array<string>,quoted:boolean,defines:boolean>>"
_CELL_EVIDENCE = [("E1", "P", True, "BASE", False, True, "Gold"), ("E2", "P", True, "ADDON", False, True, "Silver"), ("E3", "P", True, "BASE", True, False, None), ("E4", "Q", True, "BASE", False, True, None), ("E5", "P", False, "BASE", False, True, None), ("E6", "P", True, "OPTIONAL", False, True, None)]


def _limit(kind, ids=(), quoted=True, defines=False):
    return (kind, list(ids), quoted, defines)


# cell, status, limits, benefit, exclusion and quoted ids | status, validated, errors, limitations
_DRAFTS = [
    ("ok", "FULLY_COVERED", [], ["E1"], [], ["E1"], "FULLY_COVERED", True, "", ""), ("none", "NOT_STATED", [_limit("SUBLIMIT")], ["E4"], [], [], "NOT_STATED", True, "", ""), ("foreign", "FULLY_COVERED", [], ["E1", "E4"], [], ["E1"], "NOT_STATED", False, "E4: foreign", ""),
    ("unknown", "FULLY_COVERED", [], ["E1", "E9"], [], ["E1"], "NOT_STATED", False, "E9: unknown", ""), ("uncitable", "FULLY_COVERED", [], ["E5"], [], ["E5"], "NOT_STATED", False, "E5: not citable|no verified quote|no benefit evidence", ""),
    ("noquote", "FULLY_COVERED", [], ["E1"], [], [], "NOT_STATED", False, "no verified quote", ""), ("excluded", "EXCLUDED", [], [], ["E3"], ["E3"], "EXCLUDED", True, "", ""), ("notexcluded", "EXCLUDED", [], [], ["E1"], ["E1"], "NOT_STATED", False, "no exclusion evidence", ""),
    ("nolimit", "COVERED_WITH_LIMITATIONS", [], ["E1"], [], ["E1"], "NOT_STATED", False, "no limitation", ""), ("dropped", "COVERED_WITH_LIMITATIONS", [_limit("OTHER_CONDITION", (), False)], ["E1"], [], ["E1"], "FULLY_COVERED", True, "", ""),
    ("defining", "COVERED_WITH_LIMITATIONS", [_limit("SUBLIMIT", ["E1"], True, True)], ["E1"], [], ["E1"], "FULLY_COVERED", True, "", ""), ("optional", "COVERED_VIA_ADDON", [_limit("ADDON_REQUIRED", ["E2"])], ["E1", "E2"], [], ["E1"], "FULLY_COVERED", True, "", ""),
    ("noaddon", "COVERED_VIA_ADDON", [_limit("SUBLIMIT", ["E1"])], ["E1"], [], ["E1"], "COVERED_WITH_LIMITATIONS", True, "", "SUBLIMIT"), ("onlyaddon", "FULLY_COVERED", [], ["E2"], [], ["E2"], "COVERED_VIA_ADDON", True, "", "ADDON_REQUIRED"), ("bothaddons", "FULLY_COVERED", [], ["E2", "E6"], [], ["E2"], "COVERED_VIA_ADDON", True, "", "ADDON_REQUIRED|OPTIONAL_EXTRA_PREMIUM"),
    ("limited", "FULLY_COVERED", [_limit("SUBLIMIT", ["E1"])], ["E1"], [], ["E1"], "COVERED_WITH_LIMITATIONS", True, "", "SUBLIMIT"), ("addonlimit", "COVERED_VIA_ADDON", [], ["E2"], [], ["E2"], "NOT_STATED", False, "no add-on limitation", ""),
    ("variants", "COVERED_WITH_LIMITATIONS", [_limit("VARIANT_ONLY", ["E2"])], ["E1"], [], ["E1"], "COVERED_WITH_LIMITATIONS", True, "", "SUBLIMIT"), ("variant", "COVERED_WITH_LIMITATIONS", [_limit("VARIANT_ONLY", ["E1"])], ["E1"], [], ["E1"], "COVERED_WITH_LIMITATIONS", True, "", "VARIANT_ONLY"),
]


@golden("cell_id string, status string, validated boolean, errors string, limits string", [(x[0], *x[6:]) for x in _DRAFTS])
def coverage_cells(g):
    """Coverage cells from drafts, rule by rule: R1 P14 E7 C4 J5 J12."""
    drafts = g.table(f"cell_id string, status string, limits {_LIMIT}, benefit_ids array<string>, exclusion_ids array<string>, quote_ids array<string>", [x[:6] for x in _DRAFTS], "cell_id benefit_ids exclusion_ids quote_ids")
    limits = F.transform("limits", lambda x: x.withField("ids", F.transform(x["ids"], lambda i: F.concat(F.col("run").cast("string"), F.lit(":"), i))))
    drafts = drafts.withColumn("limits", limits).withColumn("policy_id", F.lit("P")).withColumn("variants", F.array(F.lit("gold"), F.lit("Silver"))).drop("run")
    items = g.table("evidence_id string, document_id string, citable boolean, tier string, excludes boolean, benefit boolean, variant string", _CELL_EVIDENCE, "evidence_id").drop("run")
    out = rules.validated_cells(drafts, items)
    return back(out, "cell_id", "status", "validated", joined(F.transform("errors", lambda x: F.regexp_replace(x, r"^\d+:", ""))).alias("errors"), joined("limitations").alias("limits"))


_LIBRARY = [("e1", 0, "Cover", None, "room rent limit", True, ["n1"]), ("e2", 1, "Cover", None, "room only", True, []), ("e3", 2, "Cover", "Rent", "nothing", True, []), ("e4", 3, "", None, "room rent limit", False, []), ("n1", 4, "Footnotes", None, "a note", True, [])]


def _library(g: Cases):
    rows = g.table("evidence_id string, ord int, section string, row_label string, text string, citable boolean, linked_footnote_ids array<string>", _LIBRARY, "evidence_id linked_footnote_ids")
    return rows.withColumn("document_id", F.concat(F.lit("P"), F.col("run").cast("string"))).drop("run")


@golden("query_id string, found string", [("one", "e1 n1"), ("all", "e1 e2 e3 n1")])
def retrieved_items(g):
    """Items of a policy that share most words with a claim, with their footnotes, in document order: T3 T4 T1 J2."""
    asked = g.table("query_id string, text string", [("q", "The room rent")], "query_id").withColumn("policy_id", F.concat(F.lit("P"), F.col("run").cast("string"))).drop("run")
    parts = [s.retrieved(asked, _library(g), n).withColumn("kind", F.lit(k)) for n, k in ((1, "one"), (15, "all"))]
    rows = back(parts[0].unionByName(parts[1]), "query_id", "kind", "ord", F.substring_index("evidence_id", ":", -1).alias("e"))
    return rows.groupBy("run", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "e"))), lambda x: x["e"]), " ").alias("found")).withColumnRenamed("kind", "query_id")


@golden("claim_id string, cell string", [("named", "m1"), ("spoken", "m2"), ("unknown", "m1")])
def cells_of_claims(g):
    """The cells that statements are about: J10 J9."""
    cells = g.spark.createDataFrame([("P", "m1", "A"), ("P", "m2", "B"), ("Q", "m3", "A")], "policy_id string, match_id string, exposure_id string")
    said = g.table("claim_id string, match_id string", [("named", "m1"), ("spoken", None), ("unknown", "zz")], "claim_id").withColumn("policy_id", F.lit("P"))
    mentions = g.table("id string, exposure_id string", [("named", "B"), ("spoken", "B"), ("unknown", "A")], "id")
    return back(s.cells_of(said, cells, mentions), "claim_id", F.col("match_id").alias("cell"))


@golden("evidence_id string, variant string, si_condition string, tier string", [("e1", "Gold", None, "ADDON"), ("e2", "Gold", "ok", "BASE"), ("e3", None, None, "UNKNOWN")])
def label_merge(g):
    """Labels that a model gave, for fields still empty: R10 U2."""
    items = g.table("evidence_id string, variant string, si_condition string, tier string", [("e1", None, None, "UNKNOWN"), ("e2", "Gold", None, "BASE"), ("e3", None, None, "UNKNOWN")], "evidence_id").drop("run")
    answers = g.table("evidence_id string, ord int, variant string, si_condition string, tier string", [("e1", 0, "Gold", "s" * 90, "ADDON"), ("e1", 1, "Silver", "x", "BASE"), ("e2", 2, "Silver", "ok", "ADDON"), ("zz", 3, "Gold", "x", "BASE"), ("e3", 4, "Bronze", None, None)], "evidence_id").drop("run")
    return back(rules.merged_labels(items, answers, ["Gold", "Silver"]), "evidence_id", "variant", "si_condition", "tier")


_BASIS = [("f1", "WEB_SOURCED", "Offices in Pune"), ("f2", "ASSUMPTION", "Many travel")]
_STATED = [("a", "Web only", ["f1"]), ("b", "Mixed*", ["f2", "f1", "f1"]), ("c", "None", ["zz"])]


def _basis(g: Cases):
    return g.table("fact_id string, status string, value string", _BASIS, "fact_id").drop("run")


@golden("claim_id string, text string, claim_type string, basis string", [("a", "Web only", "COMPANY_FACT", "f1"), ("b", "Mixed*", "ASSUMPTION", "f2|f1")])
def claim_construction(g):
    """Statements with the facts they may rest on: X12."""
    drafts = g.table("claim_id string, text string, basis_fact_ids array<string>", _STATED, "claim_id basis_fact_ids").drop("run")
    return back(cl.company_claims(drafts, _basis(g)), "claim_id", "text", "claim_type", joined(bare(F.col("basis_fact_ids"))).alias("basis"))


@golden("claim_id string, place long, text string, basis string", [("a", 0, "Web only", "f1"), ("b", 0, "Many travel*", "f2"), ("b", 1, "Offices in Pune", "f1"), ("c", 0, "None", "zz")])
def claim_split(g):
    """Statements that mix web and assumed facts become one for each: R12."""
    drafts = g.table("claim_id string, text string, basis_fact_ids array<string>", [("a", "Web only", ["f1"]), ("b", "Mixed*", ["f2", "f1"]), ("c", "None", ["zz"])], "claim_id basis_fact_ids").withColumn("ord", F.lit(1)).drop("run")
    return back(cl.split_by_provenance(drafts, _basis(g)), "claim_id", "place", "text", joined(bare(F.col("basis_fact_ids"))).alias("basis"))


@golden("claim_id string, text string, outcome string, attempts long", [("a", "t2", "REPAIRED", 2), ("b", None, "REMOVED", None), ("c", None, "REPAIR_FAILED", 1), ("d", "t", "REPAIRED", 1)])
def repair_outcomes(g):
    """What repair attempts come to: O13."""
    tries = [("a", 1, "t1", "UNSUPPORTED", True), ("a", 2, "t2", "VERIFIED", True), ("b", 1, None, "UNSUPPORTED", False), ("b", 2, "t", "VERIFIED", False), ("c", 1, "t", "CONTRADICTED", True), ("d", 1, "t", "VERIFIED", False), ("d", 2, "u", "VERIFIED", False)]
    rows = g.table("claim_id string, attempt int, text string, status string, material boolean", tries, "claim_id").drop("run")
    return back(cl.repaired(rows), "claim_id", "text", "outcome", "attempts")


@golden("claim_id string, slide long, slot string, text string", [("CL-001", 1, "bullet", "x"), ("CL-002", 1, "benefit", "b1"), ("CL-003", 1, "condition", "c1"), ("CL-004", 1, "benefit", "b2"), ("CL-005", 1, "condition", "c2"), ("CL-006", 1, "limitation", "l"), ("CL-007", 2, "bullet", "y")])
def deck_statements(g):
    """A deck's nested slides as statements in order: P13 O2."""
    deck = g.table("slide_number int, bullets array<string>, rows array<struct<benefit:string,condition:string>>, limitations array<string>", [(1, ["x"], [("b1", "c1"), ("b2", "c2")], ["l"]), (2, ["y"], [], [])]).withColumnRenamed("run", "run_id")
    return cl.flattened(deck).select(F.col("run_id").alias("run"), "claim_id", F.col("slide_number").alias("slide"), "slot", "text")


_SELECTION = "compared_policy_ids array<string>, selected_policy_id string, selected_variant string, required_addons array<string>, relevant_exposure_ids array<string>, supporting_evidence_ids array<string>, supporting_quotes array<string>"
_ERRORS = ["compared set differs", "selected policy not compared", "E2 is of another policy", "E3 is not citable", "E9 does not exist", "no evidence of the selected policy", "no quote", "unknown exposure X9", "unknown variant", "add-on not in evidence: Nothing"]


def _chosen(g: Cases):
    """Two selections a run: a sound one, and one with every fault."""
    rows = g.table("kind string, " + _SELECTION, [("good", ["P", "Q"], "P", "Gold", ["Wellness Pack"], ["X1"], ["E1"], ["q"]), ("bad", ["P"], "Z", "Tin", ["Nothing"], ["X9"], ["E2", "E3", "E9"], [])])
    return rows.withColumn("run_id", F.concat_ws(":", F.col("run").cast("string"), "kind")).drop("run", "kind")


@golden("run_id string, error string", [("bad", e) for e in _ERRORS])
def selection_faults(g):
    """Rules that selections break: J12 R14."""
    runs = g.table("run_id string, policy_id string", [("good", "Q"), ("good", "P"), ("bad", "P"), ("bad", "Q")], "run_id")
    exposures = g.table("run_id string, exposure_id string", [("good", "X1"), ("bad", "X1")], "run_id")
    items = g.spark.createDataFrame([("E1", "P", True, "s", None, "The Wellness  Pack pays"), ("E2", "R", True, "s", None, "t"), ("E3", "Q", False, "s", None, "t")], "evidence_id string, document_id string, citable boolean, section string, row_label string, text string")
    variants = g.spark.createDataFrame([("P", "G old")], "policy_id string, variant string")
    return back(s.selection_errors(_chosen(g), runs, exposures, items, variants), "run_id", "error")


@golden("run_id string, error string", [("bad", "other policy"), ("extra", "no selection")])
def deck_faults(g):
    """Decks that do not recommend what was selected: R14."""
    decks = g.table("run_id string, policy_id string, variant string", [("good", "P", "gold"), ("bad", "P", None), ("extra", "P", None)], "run_id")
    return back(s.deck_errors(decks, _chosen(g)), "run_id", "error")


@golden("run_id string, policy string, variant string, addons string, decided string", [("good", "Q", None, "", "advisor"), ("bad", "Z", "Tin", "Nothing", "llm")])
def advisor_overrides(g):
    """Selections after an adviser's override: X17."""
    over = g.table("run_id string, policy_id string, reason string", [("good", "Q", "client asked"), ("bad", "Q", "why")], "run_id")
    out = s.overridden(_chosen(g).withColumn("decided_by", F.lit("llm")), over)
    return back(out, "run_id", F.col("selected_policy_id").alias("policy"), F.col("selected_variant").alias("variant"), joined("required_addons").alias("addons"), F.col("decided_by").alias("decided"))


@golden("claim_id string, text string, state string", [("a", "2", "DIRTY"), ("b", "x", "AUDITED")])
def statement_edits(g):
    """Statements with the last edit of each: X17 E4."""
    claims = g.table("claim_id string, text string, state string", [("a", "old", "AUDITED"), ("b", "x", "AUDITED")], "claim_id").drop("run")
    edits = g.table("claim_id string, text string, at int", [("a", "1", 1), ("a", "2", 2)], "claim_id").drop("run")
    return back(s.edited(claims, edits), "claim_id", "text", "state")


_POINTS = [("p1", "M1", "We run 40 centres", "We run 40 centres, exactly", "It matters to 500 staff", ["exactly"], ["500 staff"], []), ("p2", "M1", "We run 40 centres", "We run 40 centres exactly", "x", [], ["f"], []), ("p3", "M2", None, "t", "x", [], ["f"], []), ("p4", "M3", "We run 40 centres", "Bluecare runs 41 centres", "It matters to 900 staff", ["exactly"], [], ["X9"])]


@golden("point_id string, problems string, kept boolean", [("p1", "", True), ("p2", "", False), ("p3", "not a documented capability", False), ("p4", "changes a number|keep exactly|names a product|needs company facts|unknown exposures|number not in the facts", False)])
def slide_points(g):
    """What is wrong with a slide's points about capabilities: X11 X9."""
    df = g.table("point_id string, record_id string, record_fact string, capability_text string, link_text string, required array<string>, basis_values array<string>, unknown_exposures array<string>", _POINTS, "point_id record_id").drop("run")
    num = lambda c: q.quantities(F.coalesce(c, F.lit("")), False)
    df = df.withColumn("capability_numbers", num(F.col("capability_text"))).withColumn("record_numbers", num(F.col("record_fact"))).withColumn("link_numbers", num(F.col("link_text"))).withColumn("basis_numbers", num(F.array_join("basis_values", " ")))
    return back(s.point_problems(df, ALIASES), "point_id", joined("problems").alias("problems"), "kept")


@golden("row long, kind string, text string, ord long", [(1, "WAITING", "A wait", 1), (1, "SUBLIMIT", "A limit", 2)])
def limitation_topup(g):
    """Limitations to show, by kind, without those there: T6 T7 A13."""
    cells = g.table("row int, place int, kind string, text string", [(1, 1, "SUBLIMIT", "A limit"), (1, 2, "WAITING", "A wait"), (2, 1, "WAITING", "a  WAIT"), (3, 1, "WAITING", "Old"), (3, 2, "OTHER", "z")]).withColumnRenamed("run", "run_id")
    there = g.table("text string", [("old",)]).withColumnRenamed("run", "run_id")
    return s.limitation_topup(cells, ["WAITING", "SUBLIMIT"], 2, there).select(F.col("run_id").alias("run"), "row", "kind", "text", "ord")


@golden("kind string, n long", [("a", 2), ("c", 0)])
def quota_faults(g):
    """Kinds whose number is out of bounds: A13."""
    rows = g.table("kind string", [("a",), ("a",), ("b",)])
    return s.limits_kept(rows, "run", "kind", {"a": (0, 1), "b": (1, 1), "c": (1, 2)})


@golden("text string, line double", [("line", 11.0), ("far", 31.0), ("1", 11.0)])
def region_spans(g):
    """Text spans of a page region in reading order, superscripts with their line: X20."""
    spans = g.table("x0 double, y0 double, x1 double, y1 double, text string, superscript boolean", [(1.0, 10.0, 5.0, 12.0, "line", False), (1.0, 30.0, 5.0, 32.0, "far", False), (6.0, 13.0, 7.0, 14.0, "1", True), (90.0, 10.0, 95.0, 12.0, "out", False)]).withColumnRenamed("run", "page")
    regions = g.table("region_id int, x0 double, y0 double, x1 double, y1 double", [(7, 0.0, 0.0, 50.0, 50.0)]).withColumnRenamed("run", "page")
    return s.in_region(spans, regions).select(F.col("page").alias("run"), "text", F.col("line_y").alias("line"))


@golden("id long, heading long", [(1, 3)])
def nearest_headings(g):
    """The heading above each block that overlaps it sideways: J19."""
    blocks = g.table("block int, x0 double, x1 double, top double", [(1, 0.0, 10.0, 50.0), (2, 20.0, 30.0, 50.0)]).withColumnRenamed("run", "page").withColumn("id", F.col("page") * 10 + F.col("block"))
    heads = g.table("hid int, hx0 double, hx1 double, bottom double", [(1, 0.0, 10.0, 40.0), (2, 5.0, 8.0, 45.0), (3, 5.0, 8.0, 60.0)]).withColumnRenamed("run", "page")
    return joins.closest_above(blocks, heads).select(F.col("page").alias("run"), F.col("block").alias("id"), F.col("hid").alias("heading"))


@golden("x0 double, text string", [(1.0, "other"), (50.0, "A cell")])
def loose_pictures(g):
    """Text boxes that no larger box has with their text: J20."""
    inner = g.table("x0 double, y0 double, x1 double, y1 double, text string", [(1.0, 1.0, 2.0, 2.0, "A cell"), (1.0, 1.0, 2.0, 2.0, "other"), (50.0, 1.0, 60.0, 2.0, "A cell")]).withColumnRenamed("run", "page")
    boxes = g.table("x0 double, y0 double, x1 double, y1 double, text string", [(0.0, 0.0, 10.0, 10.0, "table with a cell")]).withColumnRenamed("run", "page")
    return joins.not_contained(inner, boxes).select(F.col("page").alias("run"), "x0", "text")


@golden("place long, cluster long", [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 4)])
def line_clusters(g):
    """Lines whose heights lie together, from the first of each cluster on: O4 O14."""
    pages = g.table("y array<double>", [([1.0, 2.5, 3.0, 4.9, 5.0, 9.0],)])
    return pages.select("run", F.posexplode(ordered.anchored(F.col("y"), 2.0)).alias("place", "cluster"))


_TEXTS = ["Room rent is paid.", "room rent is paid", "It covers maternity and newborn care", "It covers maternity and newborn care for all members", "red green blue black", "red green blue white", "red green blue black"]


@golden("ord long", [(0,), (2,), (4,), (5,)])
def distinct_statements(g):
    """Statements in order without those that duplicate one kept before: O5 E6."""
    rows = g.table("place int, text string", list(enumerate(_TEXTS))).withColumn("ord", F.col("run") * 100 + F.col("place"))
    pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.run") == F.col("y.run")) & (F.col("x.ord") < F.col("y.ord"))).where(p.duplicate(F.col("x.text"), F.col("y.text"))).select(F.col("x.ord").alias("a"), F.col("y.ord").alias("b"))
    scratch(g.spark)
    return ordered.greedy_conflicts(rows.select("run", "place", "ord"), pairs).select("run", F.col("place").alias("ord"))


_PAGES = [(0, "http://www.acme.com/a?q=1", "Acme makes steel. " * 3), (1, "https://acme.com/a#x", "Other text"), (2, "http://b.org/x", "ACME, makes steel? " * 3), (3, "http://c.org/", "Something of its own"), (4, "http://c.org", "Yet another"), (5, "http://d.org", "something of its OWN!")]


@golden("page long", [(0,), (3,)])
def distinct_pages(g):
    """Pages in order without those whose URL or opening a kept page has: O6 F11."""
    rows = g.table("page int, url string, text string", _PAGES).withColumn("o", F.col("run") * 100 + F.col("page"))
    mark = lambda c: F.concat(F.col("run").cast("string"), F.lit(" "), c)
    scratch(g.spark)
    keyed = rows.withColumn("a", mark(t.url_key("url"))).withColumn("b", mark(t.opening("text")))
    return ordered.greedy_two_keys(keyed, "o", "a", "b").select("run", "page")


_RESULTS = [(0, "http://en.wikipedia.org/Acme", "Acme - wiki", "", "Acme makes steel in long lines of thirty.", 0.9), (1, "http://www.acme.com", "Acme", "", "Acme makes steel in long lines, they say.", 0.1), (2, "http://x.org", "None", "", "Nothing here is of the firm in question.", 0.99), (3, "http://ag.com", "News", "", "The plants of Acme Global grow and grow.", 0.5), (4, "http://acmeglobal.in", "", "", "Acme's own page in another land, so long.", 0.5)]


@golden("page long, official boolean, rank long", [(3, True, 1), (4, True, 2), (1, True, 3), (0, False, 4)])
def ranked_sources(g):
    """Pages that name the company, its own ones first, then by score: P15 T2."""
    rows = g.table("page int, url string, title string, excerpt string, raw string, score double", _RESULTS).withColumn("tokens", t.name_tokens(F.lit("Acme Global Ltd")))
    rows = rows.withColumn("text", t.page_text("excerpt", "raw")).withColumn("official", t.is_official("url", F.col("tokens")))
    kept = rows.where((F.col("text") != "") & F.exists("tokens", lambda w: F.contains(F.lower(F.concat_ws(" ", "title", "text")), w)))
    order = [F.desc("official"), F.desc("score"), "page"]  # equal scores: the order of the results
    return ordered.quota(kept, ["run"], order, 6, "rank").select("run", "page", "official", "rank")


_PAGE = "Menu\nWe use cookies to make this a better site for you\nAcme makes steel in plants all over the world.\nAcme makes steel in plants all over the world.\n  Its  staff travel between the plants every week. \nshort"


@golden("k long, text string", [(0, "Excerpt of it\nAcme makes steel in plants all over the world.\nIts staff travel between the plants every week."), (1, "Its staff travel between the plants every week.\nAcme makes steel in plants all over the world."), (2, "")])
def cleaned_pages(g):
    """A page's excerpt and its lines that say something, each once: P16 E1."""
    rows = g.table("k int, excerpt string, raw string", [(0, "Excerpt  of it", _PAGE), (1, "Its staff travel between the plants every week.", _PAGE), (2, None, None)])
    return rows.select("run", "k", t.page_text("excerpt", "raw").alias("text"))


@golden("claim_id string, new_id string", [("c4", "CL-001")])
def cascading_removal(g):
    """Statements without the removed ones and what goes with them, numbered anew: X13."""
    rows = g.table("claim_id string, ord int, slot string, row_id string, frames string", [("c1", 1, "benefit", "w", None), ("c2", 2, "condition", "w", None), ("c3", 3, "bullet", None, "c5"), ("c4", 4, "bullet", None, None), ("c5", 5, "bullet", None, None)], "claim_id row_id frames").withColumn("run_id", F.col("run")).drop("run")
    gone = g.table("claim_id string", [("c1",), ("c5",)], "claim_id").drop("run")
    return back(rules.without(rows, gone), "claim_id", "new_id")


@golden("name string, id string", [("x.pdf", "POL-X"), ("y.pdf", "POL-UPL-ABCDEF"), ("z.pdf", "POL-UPL-ABCDEF")])
def document_ids(g):
    """Ids of bundled and uploaded files: X22 X16."""
    rows = g.table("name string, folder string, sha string", [("x.pdf", "home", "abcdef99"), ("y.pdf", "home", "abcdef99"), ("z.pdf", "else", "abcdef99")])
    return rows.select("run", "name", s.document_id(F.col("name"), F.col("folder"), F.col("sha"), {"x.pdf": "POL-X", "z.pdf": "POL-Z"}, "home").alias("id"))


@golden("run_id string, message string", [("r1", "1 statement(s) must be changed"), ("r2", "1 item(s) to review"), ("r3", "Ready")])
def attention_messages(g):
    """What an adviser is told: X25 A14."""
    items = g.table("run_id string, kind string", [("r1", "fail"), ("r1", "review"), ("r2", "review"), ("r3", "none")], "run_id").drop("run")
    return back(s.attention(items), "run_id", "message")


_ITEMS = [("i1", "FOOTNOTE", "S", None, None, "3"), ("i2", "TEXT", "S", None, None, "two words"), ("i3", "TEXT", "S", "Row", None, "x"), ("i4", "TEXT", "T", None, None, "three words here"), ("h1", "HEADING", "S", None, None, "Cover"), ("h2", "HEADING", "U", None, None, "Cover"), ("h3", "HEADING", "U", None, None, "All of the cover"), ("i5", "TEXT", "V", None, None, "short"), ("h4", "HEADING", "V", None, None, "Vee")]


@golden("evidence_id string, citable boolean", [("i1", True), ("i2", False), ("i3", True), ("i4", True), ("h1", True), ("h2", False), ("h3", True), ("i5", False), ("h4", False)])
def citable_items(g):
    """Items that may be cited; a heading needs words, or a citable item in its section: P1 P2."""
    rows = g.table("evidence_id string, item_type string, section string, row_label string, column_label string, text string", _ITEMS, "evidence_id").withColumn("document_id", F.col("run")).drop("run")
    return back(ev.with_citable(rows, least=3), "evidence_id", "citable")


@golden("k long, name string, code string", [(0, "Acme", None), (1, None, "MISSING_COMPANY_NAME"), (2, None, "COMPANY_NAME_TOO_SHORT"), (3, None, "COMPANY_NAME_TOO_LONG"), (4, None, "MISSING_COMPANY_NAME")])
def checked_names(g):
    """Company names with the first rule they break: P18."""
    rows = g.table("k int, given string", [(0, "  Acme "), (1, "   "), (2, "A"), (3, "x" * 121), (4, None)])
    v = ev.checked_name(F.col("given"))
    return rows.select("run", "k", v["name"].alias("name"), v["code"].alias("code"))


@golden("k long, code string", [(0, None), (1, "UNKNOWN_POLICY"), (2, "NO_BUNDLED_POLICY"), (3, "TOO_MANY_BUNDLED_POLICIES"), (4, None)])
def checked_choices(g):
    """Choices from the library: known, one, and not more: P18 X16."""
    rows = g.table("k int, ids array<string>", [(0, ["P"]), (1, ["P", "Z"]), (2, [" ", None]), (3, ["P", "Q"]), (4, ["Q", "Q"])])
    return rows.select("run", "k", ev.checked_choice(F.col("ids"), ["P", "Q"]).alias("code"))


@golden("page long, words long", [(2, 1), (3, 0)])
def low_text_pages(g):
    """Pages whose text layer has too few words: X21."""
    words = g.table("page int, word string", [(1, w) for w in "a b c d e".split()] + [(2, "x")]).withColumnRenamed("run", "document")
    pages = g.table("page int", [(1,), (2,), (3,)]).withColumnRenamed("run", "document")
    return ev.low_text(pages, words, "document", 3).select(F.col("document").alias("run"), "page", "words")


@golden("evidence_id string, row long, section long", [("a", 2, 3), ("b", 2, 3), ("c", 1, 3), ("d", 1, 1)])
def context_peers(g):
    """Items with how many stand in their row and section: J6 J7 J23."""
    rows = g.table("evidence_id string, page int, table_id string, row_label string, section string", [("a", 1, "t", "Rent", "S"), ("b", 1, "t", "Rent", "S"), ("c", 1, "u", "Rent", "S"), ("d", 2, None, None, "S")], "evidence_id").withColumn("document_id", F.col("run")).drop("run")
    peers = rules.peers(rows, "row").groupBy("evidence_id").agg(F.count("*").alias("row")).join(rules.peers(rows, "section").groupBy("evidence_id").agg(F.count("*").alias("section")), "evidence_id")
    return back(peers, "evidence_id", "row", "section")


@golden("match_id string", [("m2",)])
def unavailable_cells(g):
    """Cells that a selection relies on and that do not hold at its sum insured: J13 P6."""
    cells = g.table("match_id string, exposure_id string, policy_id string, status string, available boolean", [("m1", "A", "P", "FULLY_COVERED", True), ("m2", "B", "P", "FULLY_COVERED", False), ("m3", "C", "P", "FULLY_COVERED", False), ("m4", "B", "Q", "FULLY_COVERED", False), ("m5", "B", "P", "EXCLUDED", False)]).withColumnRenamed("run", "run_id")
    chosen = g.table("selected_policy_id string, relevant_exposure_ids array<string>", [("P", ["A", "B"])]).withColumnRenamed("run", "run_id")
    return s.unavailable(chosen, cells).select(F.col("run_id").alias("run"), "match_id")


@golden("company string, state string", [("hit", "HIT"), ("old", "STALE"), ("other", "STALE"), ("none", "MISS")])
def web_cache(g):
    """Web research that can be reused: key and age decide: U6."""
    cached = g.table("company string, key string, fetched timestamp", [("hit", "k", _time(1)), ("old", "k", _time(9)), ("other", "j", _time(1))], "company").drop("run")
    asked = g.table("company string", [("hit",), ("old",), ("other",), ("none",)], "company").drop("run")
    return back(rules.cache_state(asked, cached, "company", "k", F.lit(_time(0)), 7), "company", "state")


def _time(days):
    import datetime

    return datetime.datetime(2024, 3, 20, 12) - datetime.timedelta(days=days)


@golden("path string, work boolean", [("a", False), ("b", True), ("c", True)])
def evidence_cache(g):
    """Files whose content or version has no cached extraction: U1 N14 X24."""
    files = g.table("path string, content string", [("a", "one"), ("b", "two"), ("c", "three")], "path").drop("run").withColumn("sha256", h.content_hash(F.col("content")))
    known = g.spark.createDataFrame([("one", "2"), ("two", "1")], "content string, extraction_version string").withColumn("sha256", h.content_hash(F.col("content")))
    return back(rules.uncached(files, known, "2"), "path", "work")


@golden("step string, calls long, total double", [("a", 3, 6.0), ("b", 2, 4.0), ("c", 1, 2.5), ("d", 0, 1.0)])
def step_rollup(g):
    """Steps with their own and their inner steps' calls: X19 O12 K4."""
    steps = g.table("step string, parent string, seconds double, calls int", [("a", None, 6.0, 1), ("b", "a", 4.0, 1), ("c", "b", 2.5, 1), ("d", None, 1.0, 0)]).withColumnRenamed("run", "run_id")
    return rules.rolled_up(steps).select(F.col("run_id").alias("run"), "step", "calls", F.col("seconds").alias("total"))


@golden("kind string, caught long, rate double, met boolean", [("good", 2, 1.0, True), ("poor", 1, 0.5, False)])
def evaluation(g):
    """How many false statements an audit caught and true ones it passed: A15."""
    rows = g.table("kind string, truth boolean, status string", [("good", False, "UNSUPPORTED"), ("good", False, "CONTRADICTED"), ("good", True, "VERIFIED"), ("good", True, "VERIFIED_WITH_QUALIFIER"), ("poor", False, "VERIFIED"), ("poor", False, "NEEDS_REVIEW"), ("poor", True, "VERIFIED"), ("poor", True, "NEEDS_REVIEW")])
    return rules.evaluated(rows, ["run", "kind"]).select("run", "kind", F.col("false_caught").alias("caught"), F.col("true_rate").alias("rate"), "met")


@golden("line string", [("e1 | 3 | Benefits | - | - | BASE | - | - | n1,n2 | Up to ₹500 / a day of it",), ("e2 | - | - | Row / x | - | BASE | Gold | - | - | " + "long " * 40 + "end",)])
def evidence_text(g):
    """Evidence as pipe-delimited lines, texts whole: S11."""
    items = g.table("evidence_id string, page int, section string, row_label string, column_label string, tier string, variant string, si_condition string, linked array<string>, text string", [("e1", 3, "Benefits", None, None, "BASE", None, "", ["n1", "n2"], "Up to `500 | a day\nof it"), ("e2", None, None, "Row | x", None, "BASE", "Gold", None, [], "long " * 40 + "end")])
    return items.select("run", ev.line(items).alias("line"))


# --- sources and sinks: written below the shared folder and read back


def _item(i, text, **more):
    return {"evidence_id": f"EV-{i}", "document_id": "D", "ord": i, "page": 1, "text": text, "item_type": "BULLET", "citable": True} | more


def _written(g: Cases, name: str, texts) -> str:
    """Files of one line each, as other programs leave them."""
    path = f"{scratch(g.spark)}/{name}"
    for i, text in enumerate(texts):
        g.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{i}")
    return path


@golden("evidence_id string, text string", [("EV-1", "x"), ("EV-2", "y")])
def evidence_files(g):
    """Extracted documents from JSON files; other versions and broken files are passed over: S1 S2 C1."""
    path = _written(g, "evidence", [json.dumps({"sha256": "a", "extraction_version": "2", "items": [_item(1, "x"), _item(2, "y")]}), json.dumps({"sha256": "b", "extraction_version": "1", "items": [_item(3, "z")]}), "{ not json"])
    return g.runs.crossJoin(F.broadcast(ev.items(ev.read_documents(g.spark, path + "/*", "2")).select("evidence_id", "text")))


_LONG = "a text that is longer than forty characters, so that a prefix will do"
_OVERLAY = "evidence_id string, document_id string, page int, item_type string, text string, row_label string, benefit_tier string, variant string"
_SELECTORS = "ord int, document_id string, page int, item_type string, row_label string, text_prefix string, exact boolean, fields_set array<string>, new_benefit_tier string, new_variant string"


def _overlay(g: Cases):
    rows = [("EV-1", "D", 1, "BULLET", "Short ₹5", None, "BASE", "v"), ("EV-2", "D", 1, "BULLET", _LONG + " and more", "r", "BASE", "v"), ("EV-3", "D", 1, "BULLET", "twin", None, None, "v"), ("EV-4", "D", 1, "BULLET", "twin", None, None, "v")]
    chosen = [(0, "D", 1, None, None, "short `5", True, ["benefit_tier"], "ADDON", None), (1, "D", 1, "BULLET", "R", _LONG, False, ["variant"], None, None), (2, "D", 1, None, None, "twin", True, [], None, None), (3, "D", 2, None, None, "short `5", True, [], None, None), (4, "D", 1, None, None, _LONG[:30], False, [], None, None)]
    items = g.table(_OVERLAY, rows, "evidence_id document_id").drop("run")
    selectors = g.table(_SELECTORS, chosen, "document_id").withColumn("ord", F.col("run") * 10 + F.col("ord")).drop("run")
    return items, selectors


@golden("selector long, n long", [(2, 2), (3, 0), (4, 0)])
def unresolved_selectors(g):
    """Selectors that do not match exactly one item: P3 P4."""
    items, selectors = _overlay(g)
    return ev.unresolved(items, selectors).select(F.floor(F.col("selector") / 10).alias("run"), (F.col("selector") % 10).alias("selector"), "n")


@golden("evidence_id string, tier string, variant string", [("EV-1", "ADDON", "v"), ("EV-2", "BASE", None), ("EV-3", None, "v"), ("EV-4", None, "v")])
def overlaid_labels(g):
    """Evidence with the labels that overrides set; null is a value: S2 J5."""
    items, selectors = _overlay(g)
    return back(ev.overlaid(items, selectors.where("ord % 10 < 2"), ["benefit_tier", "variant"]), "evidence_id", F.col("benefit_tier").alias("tier"), "variant")


@golden("key string, path string", [("a" * 64, "pa"), ("POL-X", "pa"), ("POL-UPL-AB0000", "pb"), ("POL-UPL-FF", None)])
def cache_paths(g):
    """Document keys to files: S3."""
    a, b = "a" * 64, "ab" + "0" * 62
    files = g.spark.createDataFrame([(a, "pa"), (b, "pb")], "sha256 string, path string")
    bundled = g.spark.createDataFrame([("POL-X", a)], "document_id string, sha256 string")
    keys = g.spark.createDataFrame([(a,), ("POL-X",), ("POL-UPL-AB0000",), ("POL-UPL-FF",)], "key string")
    return g.runs.crossJoin(F.broadcast(ev.resolved_keys(keys, files, bundled)))


@golden("ord long, id string, name string", [(0, "A", "n"), (1, "B", None)])
def yaml_records(g):
    """A list of records from YAML in file order: S4."""
    return g.runs.crossJoin(F.broadcast(ev.yaml_table(g.spark, "x:\n- id: A\n  name: n\n- id: B\n", "x", "ord int, id string, name string")))


@golden("record_id string, title string, status string", [("MS-001", "First one", "OK"), ("MS-002", "Second", "CONTEXT")])
def markdown_records(g):
    """Records of a Markdown file: S5 X9."""
    text = "# T\n\n## MS-001 — First one\n\n| Field | Value |\n|---|---|\n| Status | OK |\n| Words | keep it |\n\n## Other\n\n## MS-002 — Second\n| Field | Value |\n| :-- | --- |\n| Status | CONTEXT |\n"
    return g.runs.crossJoin(F.broadcast(ev.markdown_records(g.spark.createDataFrame([(text,)], "value string")).select("record_id", "title", F.col("fields")["Status"].alias("status"))))


@golden("event string, payload string, n long", [("start", '{"a":1}', 1), ("end", "{}", 1)])
def decision_log(g):
    """Entries appended to a log and read back: K2 S6."""
    path = f"{scratch(g.spark)}/log"
    rows = g.runs.select(F.lit("2024-01-01T00:00:00").alias("timestamp"), F.col("run").cast("string").alias("run_id"), F.lit("start").alias("event"), F.lit("system").alias("actor"), F.lit('{"a":1}').alias("payload"))
    sinks.append_log(rows, path)
    sinks.append_log(rows.withColumn("event", F.lit("end")).withColumn("payload", F.lit("{}")), path)
    return ev.read_log(g.spark, path).groupBy(F.col("run_id").cast("long").alias("run"), "event", "payload").agg(F.count("*").alias("n"))


@golden("issue string, n long", [(None, 1), ("NOT_PDF", 1), ("TOO_LARGE", 1)])
def taken_files(g):
    """Files with what is wrong with them: S9 P18."""
    path = _written(g, "files", ["%PDF-1.7", "x", "%PDF" * 100])
    return g.runs.crossJoin(F.broadcast(ev.files(g.spark, path + "/*/part-*", 100).groupBy("issue").agg(F.count("*").alias("n"))))


@golden("k long, exposures long, missing string", [(0, 0, ""), (1, 1, "f2")])
def frozen_profiles(g):
    """Frozen company profiles, old and new form: S10 C3."""
    old, new = json.dumps({"facts": [{"fact_id": "f1"}]}), json.dumps({"profile": {"facts": [{"fact_id": "f1"}]}, "exposures": [{"exposure_id": "x", "basis_fact_ids": ["f1", "f2"]}]})
    return g.runs.crossJoin(F.broadcast(ev.profile(g.spark.createDataFrame([(old,), (new,)], "value string")).select((F.size("exposures") > 0).cast("int").alias("k"), F.size("exposures").alias("exposures"), joined("missing").alias("missing"))))


@golden("claim_id string, line string", [("c1", "A / b|e2 (3)|e9 (missing)"), ("c2", "x")])
def audit_report(g):
    """Results with their statements and evidence, missing items marked: J11 X7 K3."""
    results = g.table("claim_id string, status string, supporting_evidence_ids array<string>", [("c1", "VERIFIED", ["e2", "e9"]), ("c2", "NEEDS_REVIEW", [])], "claim_id supporting_evidence_ids").drop("run")
    claims = g.table("claim_id string, text string, ord int", [("c1", "A | b", 1), ("c2", "x", 2)], "claim_id").drop("run")
    items = g.table("evidence_id string, document_id string, page int, text string", [("e2", "D", 3, "quoted"), ("e3", "D", 1, "more")], "evidence_id").drop("run")
    rows = sinks.report(results, claims, items)
    shown = F.transform(F.coalesce("evidence", F.array().cast(rows.schema["evidence"].dataType)), lambda e: F.concat(F.substring_index(e["evidence_id"], ":", -1), F.lit(" ("), F.when(e["missing"], "missing").otherwise(e["page"].cast("string")), F.lit(")")))
    return back(rows, "claim_id", F.concat_ws("|", F.translate("claim_text", "|", "/"), shown).alias("line"))


@golden("ord long, line string", [(-1, "BULLET 2"), (0, "e2 | 3 | BULLET | quoted"), (1, "e3 | 1 | BULLET | more / x")])
def review_dump(g):
    """Items of a document for review, counts first: K5."""
    items = g.table("evidence_id string, page int, text string, ord int, item_type string", [("e2", 3, "quoted", 0, "BULLET"), ("e3", 1, "more | x", 1, "BULLET")]).withColumnRenamed("run", "document_id")
    return sinks.evidence_dump(items).select(F.col("document_id").alias("run"), "ord", "line")


@golden("total double, slowest string, failed long, calls long", [(4.0, "a", 1, 2)])
def run_timing(g):
    """Total, slowest step, failed steps and calls of a run: K4 A12."""
    steps = g.table("index int, name string, parent string, seconds double, status string, model_calls int", [(0, "a", None, 2.0, "ok", 1), (1, "b", None, 2.0, "ok", 1), (2, "c", "a", 9.0, "failed", 0)]).withColumnRenamed("run", "run_id")
    return sinks.timing_report(steps).select(F.col("run_id").alias("run"), "total", "slowest", F.col("n_failed").alias("failed"), F.col("n_calls").alias("calls"))


@golden("value string", [("new",)])
def replaced_table(g):
    """A table written whole, twice: readers see the last: K1."""
    path = f"{scratch(g.spark)}/table"
    sinks.write_table(g.runs.withColumn("value", F.lit("old")), path)
    sinks.write_table(g.runs.withColumn("value", F.lit("new")), path)
    return g.spark.read.parquet(path)


_TEMPLATES = [("Audit {{claims}} of {{ policy }}; {{claims}}", {"claims": "a {{policy}}", "policy": "P"}, "Audit a {{policy}} of P; a {{policy}}", "", ""), ("For {{a}} and {{b}}", {"a": "x", "c": "y", "d": "z"}, None, "b", "c|d"), ("No mark, {b}", {}, "No mark, {b}", "", "")]


@golden("k long, text string, missing string, unused string", [(i, *x[2:]) for i, x in enumerate(_TEMPLATES)])
def filled_templates(g):
    """Templates filled in one pass; missing and unused variables are told: C7."""
    rows = g.table("k int, template string, variables map<string,string>", [(i, *x[:2]) for i, x in enumerate(_TEMPLATES)]).withColumn("f", prompts.filled(F.col("template"), F.col("variables")))
    return rows.select("run", "k", "f.text", joined("f.missing").alias("missing"), joined("f.unused").alias("unused"))


_SCHEMAS = [
    ({"type": "object", "additionalProperties": False, "default": 1, "properties": {"const": {"type": "string", "const": "x", "maxLength": 3}, "n": {"anyOf": [{"type": "integer", "exclusiveMinimum": 0}, {"type": "null"}]}}, "required": ["const"]}, {"type": "object", "additionalProperties": False, "properties": {"const": {"enum": ["x"], "type": "string"}, "n": {"anyOf": [{"type": "integer"}, {"type": "null"}]}}, "required": ["const"]}),
    ({"$defs": {"pattern": {"pattern": "a", "enum": [{"pattern": 1}], "const": 2}}, "items": {"$ref": "#/$defs/pattern"}}, {"$defs": {"pattern": {"enum": [{"pattern": 1}]}}, "items": {"$ref": "#/$defs/pattern"}}),
]


@golden("k long, schema string", [(i, json.dumps(x[1])) for i, x in enumerate(_SCHEMAS)])
def reduced_schemas(g):
    """JSON schemas with the keys that a model accepts: C6."""
    return g.table("k int, schema string", [(i, json.dumps(x[0])) for i, x in enumerate(_SCHEMAS)]).select("run", "k", prompts.reduced_schema(F.col("schema")).alias("schema"))
