"""Cases of auditing statements: policies, records, companies, web facts, routing, the gate, deck problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridock.functions import quantity as q
from veridock.functions import topics as tp
from veridock.operators import audit as au
from veridock.operators import claims as cl
from veridock.operators import rules as r
from tests.cases.golden import Cases, back, bare, golden, joined
from tests.cases.readings import ALIASES, TERMS
from veridock.session import stored

NAMES = ("golden shield", "bluecare")
EVIDENCE = "evidence_id string, document_id string, citable boolean, item_type string, section string, row_label string, column_label string, text string, tier string, variant string, si_condition string, markers array<string>, linked array<string>"
ITEMS = [
    ("E1", "POL-A", True, "BULLET", "Benefits", None, None, "Room rent is paid up to ₹5,000 a day after 24 months", "BASE", None, None, [], []),
    ("E2", "POL-B", True, "BULLET", "Benefits", None, None, "Room rent is paid", "BASE", None, None, [], []),
    ("E3", "POL-A", False, "TEXT", "Benefits", None, None, "Room rent", "BASE", None, None, [], []),
    ("E4", "POL-A", True, "BULLET", "Benefits", None, None, "Maternity is paid up to ₹50,000", "ADDON", "Gold", "sum insured above ₹25 lakh", [], ["F1"]),
    ("F1", "POL-A", True, "FOOTNOTE", "Footnotes", None, None, "(3) Only after a waiting period of 36 months.", "BASE", None, None, ["3"], []),
    ("E5", "POL-A", True, "TABLE_CELL", "Grid", "Ambulance (7 trips)", None, "₹2,000", "BASE", None, None, [], []),
    ("E7", "POL-A", True, "BULLET", "Exclusions", None, None, "Maternity is not covered", "BASE", None, None, [], []),
    ("E8", "POL-A", True, "BULLET", "Exclusions", None, None, "Air ambulance is not covered", "BASE", None, None, [], []),
    ("E9", "POL-A", True, "BULLET", "Exclusions", None, None, "A suite is not covered in the base plan", "BASE", None, None, [], []),
    ("EA", "POL-A", True, "BULLET", "Prices", None, None, "Premium ₹9,000 for a family, ages 35 and 30, sum insured ₹10 lakh", "BASE", None, None, [], []),
]
CELLS = [("POL-A", "M-AMB", "EXP-AMB", "FULLY_COVERED", False), ("POL-A", "M-AIR", "EXP-AIR", "NOT_STATED", False), ("POL-A", "M-MAT", "EXP-MAT", "EXCLUDED", True), ("POL-A", "M-ROOM", "EXP-ROOM", "COVERED_VIA_ADDON", True), ("POL-A", "M-ODD", "EXP-ODD", "EXCLUDED", False)]
_ADDED = "Applies to Gold only; Available as an add-on at extra premium; Applies for sum insured above ₹25,00,000; Only after a waiting period of 36 months."
_HEDGE = "Room rent is paid up to ₹5,000 a day after 24 months"

# claim, text, row text, type, cell | reviewer's status, ids, quote (of the first id), qualifier | status, numbers, qualifier, failed checks
POLICY = [
    ("ok", "Room rent up to ₹5,000 after 2 years", None, None, None, "VERIFIED", ["E1"], "room rent is paid up to INR 5,000", None, "VERIFIED", "PASS", "", ""),
    ("qualified", "Room rent is paid", None, None, None, "VERIFIED", ["E1"], "room rent is paid", "after 24 months", "VERIFIED_WITH_QUALIFIER", "NA", "after 24 months", ""),
    ("badqualifier", "Room rent is paid", None, None, None, "VERIFIED", ["E1"], "room rent is paid", "after 36 months", "NEEDS_REVIEW", "NA", "", "qualifier"),
    ("foreign", "Room rent is paid", None, None, None, "VERIFIED", ["E1", "E2"], "room rent is paid", None, "UNSUPPORTED", "NA", "", "ownership"),
    ("noitem", "Room rent is paid", None, None, None, "VERIFIED", ["E3"], None, None, "UNSUPPORTED", "NA", "", "ownership"),
    ("unknown", "Room rent is paid", None, None, None, "VERIFIED", ["ZZ"], None, None, "UNSUPPORTED", "NA", "", "ownership"),
    ("noquote", "Room rent is paid", None, None, None, "VERIFIED", ["E1"], None, None, "NEEDS_REVIEW", "NA", "", "quotes"),
    ("misquoted", "Room rent is paid", None, None, None, "VERIFIED", ["E1"], "all rent is paid", None, "NEEDS_REVIEW", "NA", "", "quotes"),
    ("contradicted", "Room rent up to ₹9,000", None, None, None, "VERIFIED", ["E1"], "room rent is paid", None, "CONTRADICTED", "FAIL_CONTRADICTED", "", "numbers"),
    ("missing", "Room rent at 80%", None, None, None, "VERIFIED", ["E1"], "room rent is paid", None, "UNSUPPORTED", "FAIL_MISSING", "", "numbers"),
    ("named", "Bluecare pays room rent", None, None, None, "VERIFIED", ["E1"], "room rent is paid", None, "UNSUPPORTED", "NA", "", "policy_name"),
    ("absolute", "Limitless room rent is paid", None, None, None, "VERIFIED", ["E1"], "room rent is paid", None, "NEEDS_REVIEW", "NA", _HEDGE, "absolute"),
    ("kept", "Room rent is paid", None, None, None, "CONTRADICTED", ["E1"], "room rent is paid", None, "CONTRADICTED", "NA", "", ""),
    ("none", "Room rent is paid", None, None, None, None, None, None, None, "NEEDS_REVIEW", "NA", "", ""),
    ("structured", "Maternity is paid up to ₹50,000", None, None, None, "VERIFIED", ["E4"], "maternity is paid", None, "VERIFIED_WITH_QUALIFIER", "PASS", _ADDED, ""),
    ("inrow", "Maternity is paid up to ₹50,000", "Maternity is paid up to ₹50,000 Gold add-on, sum insured above 25 lakh, only after a waiting period of 36 months", None, None, "VERIFIED", ["E4"], "maternity is paid", None, "VERIFIED", "PASS", "", ""),
    ("offtopic", "Ambulance is paid", None, None, None, "VERIFIED", ["E1"], "room rent is paid", None, "UNSUPPORTED", "NA", "", "topic_anchor"),
    ("labelled", "Ambulance up to ₹2,000 for 7 trips", None, None, None, "VERIFIED", ["E5"], "₹2,000", None, "VERIFIED", "PASS", "", ""),
    ("otherlabel", "Room rent for 7 trips", None, None, None, "VERIFIED", ["E5"], "₹2,000", None, "UNSUPPORTED", "FAIL_MISSING", "", "numbers|topic_anchor"),
    ("unbound", "Room rent is paid, maternity up to ₹5,000", None, None, None, "VERIFIED", ["E1", "E4"], "room rent is paid", None, "UNSUPPORTED", "PASS", _ADDED, "topic_anchor"),
    ("excluded", "It does not cover maternity", None, None, None, "VERIFIED", ["E7"], "maternity is not covered", None, "VERIFIED", "NA", "", ""),
    ("silent", "It does not cover air ambulance", None, None, None, "VERIFIED", ["E8"], "air ambulance is not covered", None, "UNSUPPORTED", "NA", "", "absence"),
    ("covered", "It does not cover an ambulance", None, None, None, "VERIFIED", ["E8"], "air ambulance is not covered", None, "CONTRADICTED", "NA", "", "absence"),
    ("unnamed", "It does not cover dental care", None, None, None, "VERIFIED", ["E7"], "maternity is not covered", None, "NEEDS_REVIEW", "NA", "", "absence"),
    ("byrow", "It does not cover this", None, None, "M-ODD", "VERIFIED", ["E7"], "maternity is not covered", None, "CONTRADICTED", "NA", "", "absence"),
    ("addon", "It does not cover a suite", None, None, None, "VERIFIED", ["E9"], "a suite is not covered", None, "VERIFIED_WITH_QUALIFIER", "NA", "Available as an add-on at extra premium", ""),
    ("priced", "The premium is ₹9,000", None, "POLICY_PRICING", None, "VERIFIED", ["EA"], "premium ₹9,000", None, "NEEDS_REVIEW", "PASS", "", "pricing"),
    ("explained", "A premium of ₹9,000 for a family aged 35, sum insured ₹10 lakh", None, None, None, "VERIFIED", ["EA"], "premium ₹9,000", None, "VERIFIED", "PASS", "", ""),
    ("compared", "The premium of ₹9,000 is lower than elsewhere", None, None, None, "VERIFIED", ["EA"], "premium ₹9,000", None, "UNSUPPORTED", "PASS", "", "pricing"),
]


def read_items(g: Cases):
    items = g.table(EVIDENCE, ITEMS, "evidence_id linked")
    return stored(au.with_referrers(stored(au.read_evidence(items, TERMS, NAMES))))


@golden("claim_id string, status string, number_check string, qualifier string, failed string", [(x[0], *x[9:]) for x in POLICY])
def policy_audit(g):
    """All checks on a reviewer's verdicts about a policy: R2 R11 F3 N6 N12 X1 X3 X4 J22 A16."""
    claims = g.table("claim_id string, policy_id string, text string, scope string, claim_type string, match_id string", [(x[0], "POL-A", *x[1:5]) for x in POLICY], "claim_id")
    said = [(x[0], x[5], x[6], [(x[6][0], x[7])] if x[7] else [], x[8]) for x in POLICY if x[5]]
    verdicts = g.table("claim_id string, status string, supporting_evidence_ids array<string>, quotes array<struct<evidence_id:string,quote:string>>, required_qualifier string", said, "claim_id supporting_evidence_ids quotes.evidence_id").drop("run")
    cells = g.spark.createDataFrame(CELLS, "policy_id string, match_id string, exposure_id string, status string, evidenced boolean")
    policies = g.spark.createDataFrame([("POL-A", ["Gold", "Silver"]), ("POL-B", [])], "policy_id string, variants array<string>")
    out = au.policy_verdicts(claims, verdicts, read_items(g), ALIASES, cells, policies, TERMS, NAMES)
    return back(out, "claim_id", "status", "number_check", "qualifier", joined(F.transform("failed", lambda x: x["check"])).alias("failed"))


_SILENT = [
    ("air", "Air ambulance is not stated in the brochure", None, False, "VERIFIED", ""), ("mat", "Maternity is not stated in the brochure", None, False, "CONTRADICTED", "absence"), ("contrary", "Air ambulance is not stated in the brochure", None, True, "NEEDS_REVIEW", "absence"),
    ("none", "Dental care is not stated in the brochure", None, False, "NEEDS_REVIEW", "absence"), ("other", "Air ambulance is not stated in the Bluecare brochure", None, False, "UNSUPPORTED", "policy_name"), ("row", "Not stated in the brochure", "M-AIR", False, "VERIFIED", ""),
    ("rowstated", "Not stated in the brochure", "M-AMB", False, "CONTRADICTED", "absence"),
]


@golden("claim_id string, status string, failed string", [(x[0], *x[4:]) for x in _SILENT])
def silence_audit(g):
    """Claims that a brochure is silent against the coverage cells: R6 P9 J10."""
    claims = g.table("claim_id string, text string, match_id string, contrary boolean", [x[:4] for x in _SILENT], "claim_id").withColumn("policy_id", F.lit("POL-A"))
    cells = g.spark.createDataFrame(CELLS, "policy_id string, match_id string, exposure_id string, status string, evidenced boolean")
    return back(au.not_stated_verdicts(claims, cells, ALIASES, TERMS), "claim_id", "status", joined(F.transform("failed", lambda x: x["check"])).alias("failed"))


_ABSENT = [("a", "It excludes maternity", ""), ("b", "It does not cover air ambulance", "EXP-AIR is NOT_STATED|EXP-AMB is FULLY_COVERED"), ("c", "no coverage for dental care", "names no exposure"), ("d", "Maternity is not stated in the brochure", "EXP-MAT is EXCLUDED"), ("e", "It covers maternity", ""), ("f", "It does not offer a suite", "")]


@golden("claim_id string, errors string", [(x[0], x[2]) for x in _ABSENT])
def absence_errors(g):
    """What coverage cells hold against drafts of absence statements: R6 P9."""
    claims = g.table("claim_id string, text string", [x[:2] for x in _ABSENT], "claim_id").withColumn("policy_id", F.lit("POL-A"))
    cells = g.spark.createDataFrame(CELLS, "policy_id string, match_id string, exposure_id string, status string, evidenced boolean")
    return back(au.cell_absence_errors(claims, cells, TERMS), "claim_id", joined("errors").alias("errors"))


_RECORDS = [("R1", "The firm may place cover in 130 countries", ["may"]), ("R2", "The firm runs wellness programmes", [])]
_RECORDED = [
    ("ok", "The firm may place cover in 130 countries", "VERIFIED", ["R1"], "may place cover", "VERIFIED", ""), ("dropped", "The firm places cover in 130 countries", "VERIFIED", ["R1"], "may place cover", "NEEDS_REVIEW", "condition"),
    ("number", "The firm may place cover in 150 countries", "VERIFIED", ["R1"], "may place cover", "CONTRADICTED", "numbers"), ("foreign", "The firm runs wellness programmes", "VERIFIED", ["R2", "E1"], "runs wellness", "UNSUPPORTED", "ownership"),
    ("norecord", "The firm runs wellness programmes", "VERIFIED", [], None, "UNSUPPORTED", "ownership"), ("noquote", "The firm runs wellness programmes", "VERIFIED", ["R2"], None, "NEEDS_REVIEW", "quotes"), ("product", "Bluecare runs wellness programmes", "VERIFIED", ["R2"], "runs wellness", "UNSUPPORTED", "policy_name"),
    ("absolute", "The firm always runs wellness programmes", "VERIFIED", ["R2"], "runs wellness", "NEEDS_REVIEW", "absolute"), ("none", "The firm runs it", None, None, None, "NEEDS_REVIEW", ""),
]


@golden("claim_id string, status string, failed string", [(x[0], *x[5:]) for x in _RECORDED])
def record_audit(g):
    """Statements about the adviser's own capabilities against its records: R3 X9."""
    claims = g.table("claim_id string, text string", [x[:2] for x in _RECORDED], "claim_id").drop("run")
    said = [(x[0], x[2], x[3], [(x[3][0], x[4])] if x[4] else []) for x in _RECORDED if x[2]]
    verdicts = g.table("claim_id string, status string, supporting_evidence_ids array<string>, quotes array<struct<evidence_id:string,quote:string>>", said, "claim_id supporting_evidence_ids quotes.evidence_id").drop("run")
    records = g.table("evidence_id string, text string, required array<string>", _RECORDS, "evidence_id").drop("run")
    return back(au.record_verdicts(claims, verdicts, records, ALIASES), "claim_id", "status", joined(F.transform("failed", lambda x: x["check"])).alias("failed"))


_FACTS = [
    ("f1", 0, "headcount_band", "Acme has over 300,000 employees in Pune", "WEB_SOURCED", ["W1"], ["has 317,000 employees in Pune today"]), ("f2", 1, "geography", "Acme has offices in Berlin", "WEB_SOURCED", ["W1"], ["has 317,000 employees in Pune today"]),
    ("f3", 2, "geography", "Acme works in 12 countries", "WEB_SOURCED", ["W1"], ["has 317,000 employees in Pune today"]), ("f4", 3, "industry", "Acme makes steel", "WEB_SOURCED", ["W9"], ["makes steel for all the world"]), ("f5", 4, "industry", "Acme makes steel", "WEB_SOURCED", ["W1"], ["makes steel"]),
    ("f6", 5, "industry", "Acme makes steel", "WEB_SOURCED", [], []), ("f7", 6, "industry", "Acme makes steel", "WEB_SOURCED", ["W2"], ["Acme makes steel and fine wire"]), ("f8", 7, "size", "Acme has 5,000 people", "MODEL_KNOWLEDGE", [], []),
    ("f9", 8, "size", "over 5,000 people", "MODEL_KNOWLEDGE", [], []), ("fa", 9, "industry", "revenue of 500 million", "WEB_SOURCED", ["W3"], ["a revenue of 500 million"]), ("fb", 10, "business_risk", "Staff travel to plants", "ASSUMPTION", [], []),
]
_PAGES = [("W1", "Acme has 317,000 employees in Pune today."), ("W2", "Acme makes steel and fine wire."), ("W3", "It reached a revenue of 500 million.")]
_WEB = [
    ("f1", "", "WEB_SOURCED"), ("f2", "name not in the quotes", "MODEL_KNOWLEDGE"), ("f3", "number not in the quotes", "MODEL_KNOWLEDGE"), ("f4", "unknown source|quote not in its sources", "MODEL_KNOWLEDGE"), ("f5", "quote too short", "MODEL_KNOWLEDGE"), ("f6", "no source cited|no quote given", "MODEL_KNOWLEDGE"),
    ("f7", "", "WEB_SOURCED"), ("f8", "", "ASSUMPTION"), ("f9", "", "MODEL_KNOWLEDGE"), ("fa", "", "ASSUMPTION"), ("fb", "", "ASSUMPTION"),
]
_FACT = "fact_id string, ord int, field string, value string, status string, source_ids array<string>, quotes array<string>"


def _facts(g: Cases):
    return g.table(_FACT, _FACTS).withColumnRenamed("run", "run_id").withColumn("company", F.lit("Acme")).withColumn("recognised", F.lit(True))


def _pages(g: Cases):
    return g.table("source_id string, content string", _PAGES).withColumnRenamed("run", "run_id")


@golden("fact_id string, problems string, status string", _WEB)
def web_fact_check(g):
    """Facts said to be from the web against their pages: R8 X26 N7."""
    out = au.resolved_facts(_facts(g), _pages(g))
    return out.select(F.col("run_id").alias("run"), "fact_id", joined("problems").alias("problems"), "status")


_COMPANY = [
    ("web", 1, "Acme makes steel", ["f7"], True, "VERIFIED", ""), ("unmarked", 1, "Acme makes steel", ["f7"], False, "NEEDS_REVIEW", "label"), ("marked", 1, "Acme has over 5,000 people*", ["f9"], False, "LABELLED_ASSUMPTION", ""),
    ("wording", 1, "Acme makes beautiful steel", ["f7"], True, "NEEDS_REVIEW", "wording"), ("number", 3, "Acme has over 9,000 people*", ["f9"], False, "CONTRADICTED", "numbers"), ("figure", 3, "Acme has 5,000 employees*", ["f8"], False, "NEEDS_REVIEW", "precise_figure"), ("risk", 3, "Staff travel to plants*", ["fb"], False, "NEEDS_REVIEW", "company"),
    ("risk1", 1, "Staff travel to plants*", ["fb"], False, "LABELLED_ASSUMPTION", ""), ("nobasis", 1, "Acme makes steel*", [], False, "UNSUPPORTED", "company"), ("unknown", 1, "Acme makes steel*", ["f7", "zz"], False, "UNSUPPORTED", "company"), ("notweb", 1, "Acme has over 5,000 people", ["f9"], True, "NEEDS_REVIEW", "web_source"),
]


@golden("claim_id string, status string, failed string", [(x[0], *x[5:]) for x in _COMPANY])
def company_audit(g):
    """Statements about the company against its checked facts: R4 F19 A16."""
    claims = g.table("claim_id string, slide int, text string, basis_fact_ids array<string>, web boolean", [x[:5] for x in _COMPANY]).withColumnRenamed("run", "run_id")
    runs = g.runs.select(F.col("run").alias("run_id"), F.lit("Acme").alias("company"), F.lit(True).alias("has_profile"))
    out = au.company_verdicts(claims, au.resolved_facts(_facts(g), _pages(g)), runs)
    return out.select(F.col("run_id").alias("run"), "claim_id", "status", joined(F.transform("failed", lambda x: x["check"])).alias("failed"))


_LINKS = [("ok", "Steel plants mean 317,000 people travel", ["f1"], "NEEDS_REVIEW"), ("same", "Over 300,000 people travel", ["f1"], "NON_FACTUAL"), ("unknown", "They travel", ["zz"], "NEEDS_REVIEW"), ("product", "Bluecare fits them", ["f7"], "NEEDS_REVIEW"), ("plain", "They travel", ["f7"], "NON_FACTUAL")]


@golden("claim_id string, status string", [(x[0], x[3]) for x in _LINKS])
def link_audit(g):
    """Lines that say why something matters to the client: R5."""
    claims = g.table("claim_id string, text string, basis_fact_ids array<string>", [x[:3] for x in _LINKS]).withColumnRenamed("run", "run_id")
    return au.link_verdicts(claims, _facts(g), ALIASES).select(F.col("run_id").alias("run"), "claim_id", "status")


_ASSUMED = [("a", "Assumed sum insured of ₹10 lakh*", "LABELLED_ASSUMPTION"), ("b", "Assumed sum insured of ₹5 lakh*", "NEEDS_REVIEW"), ("c", "Assumed sum insured of ₹10 lakh", "NEEDS_REVIEW"), ("d", "Assumed 5 members*", "LABELLED_ASSUMPTION")]


@golden("claim_id string, status string", [(x[0], x[2]) for x in _ASSUMED])
def run_assumptions(g):
    """Assumptions of the run without facts: R5."""
    rows = g.table("claim_id string, text string", [x[:2] for x in _ASSUMED]).withColumn("n", q.quantities(F.col("text"), False))
    return rows.select("run", "claim_id", au.assumption_status(F.col("text"), F.col("n"), F.lit(1e6)).alias("status"))


_ROUTES = [
    ("a", 2, "POLICY_BENEFIT", "POL-A", None, "x", 0, "code", None, "UNSUPPORTED"), ("b", 2, "CAPABILITY_STATEMENT", None, None, "x", 0, "records", None, None), ("c", 2, "NON_FACTUAL", None, None, "x", 1, "link", None, None), ("d", 2, "NON_FACTUAL", None, None, "Why us", 0, "code", None, "NON_FACTUAL"),
    ("e", 2, "NON_FACTUAL", None, None, "Our 5 reasons", 0, "code", None, "NEEDS_REVIEW"), ("f", 4, "NON_FACTUAL", None, None, "Golden Shield leads", 0, "policy", "POL-A", None), ("g", 4, "NON_FACTUAL", None, None, "Golden Shield and Bluecare lead", 0, "code", None, "NEEDS_REVIEW"), ("h", 4, "NON_FACTUAL", None, None, "In 5 ways", 0, "code", None, "NEEDS_REVIEW"),
    ("i", 1, "COMPANY_FACT", None, None, "x", 0, "company", None, None), ("j", 1, "ASSUMPTION", None, None, "x", 1, "company", None, None), ("k", 1, "ASSUMPTION", None, None, "x*", 0, "assumption", None, None), ("l", 4, "POLICY_BENEFIT", None, None, "Bluecare pays", 0, "policy", "POL-B", None),
    ("m", 4, "POLICY_BENEFIT", None, None, "It pays", 0, "code", None, "UNSUPPORTED"), ("n", 4, "POLICY_BENEFIT", "POL-Z", None, "It pays", 0, "code", None, "UNSUPPORTED"), ("o", 3, "POLICY_BENEFIT", "POL-A", "M-1", "Not stated in the brochure", 0, "not_stated", "POL-A", None), ("p", 4, "POLICY_BENEFIT", "POL-A", None, "Dental is not stated in the brochure", 0, "not_stated", "POL-A", None),
    ("q", 4, "POLICY_LIMIT", "POL-A", None, "It pays 5", 0, "policy", "POL-A", None),
]


@golden("claim_id string, route string, policy_id string, status string", [(x[0], *x[7:]) for x in _ROUTES])
def statement_routes(g):
    """Where each statement is judged: R7 R5 X5."""
    claims = g.table("claim_id string, slide int, claim_type string, policy_id string, match_id string, text string, n_basis int", [x[:7] for x in _ROUTES], "claim_id").drop("run")
    policies = g.spark.createDataFrame([("POL-A",), ("POL-B",)], "policy_id string")
    return back(au.routed(claims, policies, ALIASES, NAMES), "claim_id", "route", "policy_id", "status")


_PICKS = [(0, "EXP-AMB", ["f7"]), (1, "EXP-ZZ", ["f7"]), (2, "EXP-MAT", ["f9", "zz"]), (3, "EXP-AMB", ["f9"]), (4, "EXP-AIR", ["fb"]), (5, "EXP-ROOM", ["f6", "f1"]), (6, "EXP-ODD", []), (7, "EXP-LAST", ["f2"])]


@golden("exposure_id string, place long, baseline boolean, basis string, assumption_based boolean", [("EXP-HOSP", 1, True, "f1|f8|f9", False), ("EXP-MAT", 2, True, "f9", False), ("EXP-AMB", 3, False, "f7", True), ("EXP-ROOM", 4, False, "f6|f1", True), ("EXP-LAST", 5, False, "f2", False)])
def exposure_choice(g):
    """Exposures of each run: baselines first, picks that exist and have facts, whether they rest on assumptions: R9 X23 T5."""
    taxonomy = g.spark.createDataFrame([("EXP-HOSP", 0, True), ("EXP-MAT", 1, True), ("EXP-AMB", 2, False), ("EXP-AIR", 3, False), ("EXP-ROOM", 4, False), ("EXP-ODD", 5, False), ("EXP-LAST", 6, False)], "exposure_id string, ord int, baseline boolean")
    picks = g.table("ord int, exposure_id string, fact_ids array<string>", _PICKS).withColumnRenamed("run", "run_id")
    facts = au.resolved_facts(_facts(g), _pages(g)).select("run_id", "fact_id", "ord", "field", F.when(F.col("fact_id") == "f2", "WEB_SOURCED").otherwise(F.col("status")).alias("status"))
    out = r.selected_exposures(picks, taxonomy, facts, most=5)
    return out.select(F.col("run_id").alias("run"), "exposure_id", "place", "baseline", joined("basis").alias("basis"), "assumption_based")


_GATED = [
    ("a", "AUDITED", "CONTRADICTED", True, ["numbers"], True, True, 0, "CONTRADICTED fail|NUMBER_CHECK fail"), ("b", "AUDITED", "UNSUPPORTED", True, ["policy_name"], False, True, 2, "UNSUPPORTED fail|POLICY_REFERENCE fail|REPAIR_FAILED review"), ("c", "AUDITED", "UNSUPPORTED", False, ["slide2"], False, True, 0, "UNSUPPORTED review|SLIDE2 fail"),
    ("d", "DIRTY", "NEEDS_REVIEW", False, [], False, True, 0, "DIRTY fail|NEEDS_REVIEW review"), ("e", "AUDITED", "VERIFIED_WITH_QUALIFIER", True, [], False, False, 0, "QUALIFIER_NOT_RENDERED review"), ("f", "AUDITED", "VERIFIED_WITH_QUALIFIER", True, [], False, True, 0, ""),
    ("g", "REMOVED", "CONTRADICTED", True, ["numbers"], True, True, 0, ""), ("h", "AUDITED", "ADVISOR_ATTESTED", True, ["policy_name"], True, True, 1, "ATTESTED review"), ("i", "AUDITED", "VERIFIED", True, [], False, True, 0, ""),
]


@golden("claim_id string, items string", [(x[0], x[8]) for x in _GATED if x[8]])
def claim_gate(g):
    """The gate's rules for statements: A4 A14."""
    rows = g.table("claim_id string, state string, status string, material boolean, failed array<string>, number_failed boolean, qualifier_shown boolean, n_repairs int", [x[:8] for x in _GATED], "claim_id").drop("run")
    items = r.gate_items(rows, "claim_id", au.claim_gate_rules())
    return back(items.groupBy("claim_id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item_id", "kind"))), lambda x: F.concat_ws(" ", x["item_id"], x["kind"]))).alias("items")), "claim_id", "items")


_SHOWN = [("POL-A", "after 24 months", "after 24 months", True), ("POL-A", "after 24 months", None, False), (None, "x", "x", False), ("POL-A", "y" * 201, "y" * 201, False), ("POL-A", "up to `500", "up to `500", False), ("POL-A", "", "", False)]


@golden("k long, shown boolean, qualifier string, status string", [(i, x[3], "a; b", "VERIFIED_WITH_QUALIFIER" if i % 2 else "VERIFIED") for i, x in enumerate(_SHOWN)])
def qualifiers_shown(g):
    """Qualifiers that can be and are shown, and parts joined once in order: R11 X6 X14."""
    rows = g.table("k int, policy_id string, wanted string, text string", [(i, *x[:3]) for i, x in enumerate(_SHOWN)])
    joined_parts = r.qualifier([F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit("b"), F.lit("a")])
    return rows.select("run", "k", au.qualifier_shown(F.col("policy_id"), F.col("wanted"), F.col("text")).alias("shown"), joined_parts.alias("qualifier"), r.with_qualifier(F.lit("VERIFIED"), F.when(F.col("k") % 2 == 1, F.lit("x")).otherwise("")).alias("status"))


_DRAFTED = [
    ("ok", 4, "POLICY_BENEFIT", "POL-A", "Golden Shield pays room rent", None, False, 1, False, False, [], ""), ("other", 4, "POLICY_BENEFIT", "POL-B", "It pays room rent", None, False, 1, False, False, [], "is about another policy"), ("names", 4, "POLICY_BENEFIT", "POL-A", "Bluecare pays", None, False, 1, False, False, [], "names POL-B"),
    ("chosen", 4, "POLICY_BENEFIT", "POL-B", "Bluecare pays less", None, True, 1, False, False, [], ""), ("tick", 4, "POLICY_BENEFIT", "POL-A", "pays `500", None, False, 1, False, False, [], "has a backtick before a digit"), ("risk", 3, "ASSUMPTION", None, "x", None, False, 0, True, False, [], "uses a business risk outside slide 1"),
    ("slide2", 2, "POLICY_BENEFIT", "POL-A", "pays", None, False, 1, False, False, [], "slide 2 has records only"), ("uncited", 4, "POLICY_BENEFIT", "POL-A", "pays", None, False, 0, False, False, [], "cites no evidence"), ("silent", 4, "POLICY_BENEFIT", "POL-A", "Dental is not stated in the brochure", None, False, 0, False, False, [], ""),
    ("row", 3, "POLICY_BENEFIT", "POL-A", "Not stated in the brochure", "M-1", False, 0, False, False, ["x"], ""), ("absent", 4, "POLICY_BENEFIT", "POL-A", "excludes it", None, False, 1, False, False, ["names no exposure"], "names no exposure"), ("frame", 4, "ASSUMPTION", None, "which ensures it all", None, False, 0, False, True, [], "is no complete sentence"),
    ("worded", 4, "POLICY_BENEFIT", "POL-NIVA", "day care is paid", None, False, 1, False, False, [], "is about another policy|write the hours of hospitalisation, not day care"),
]


@golden("claim_id string, problems string", [(x[0], x[-1]) for x in _DRAFTED])
def draft_problems(g):
    """What is wrong with a deck's drafts: P19 P12."""
    rows = g.table("claim_id string, slide int, claim_type string, policy_id string, text string, match_id string, from_selection boolean, n_cited int, risk boolean, framing boolean, absence_errors array<string>", [x[:-1] for x in _DRAFTED], "claim_id").drop("run")
    rows = rows.withColumn("selected", F.lit("POL-A")).withColumn("compared", F.array(F.lit("POL-A"), F.lit("POL-B")))
    return back(au.claim_problems(rows, ALIASES), "claim_id", joined("problems").alias("problems"))


@golden("industry string, size string", [("Acme makes steel", "Acme has over 300,000 employees in Pune")])
def profile_summary(g):
    """A company's fields: web-sourced values first, a head count before a size: T8."""
    facts = au.resolved_facts(_facts(g), _pages(g)).select("run_id", "field", "value", "status", "ord")
    return cl.profile_fields(facts).select(F.col("run_id").alias("run"), "industry", "size")
