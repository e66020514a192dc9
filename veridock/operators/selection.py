"""Policy selection, slide points, retrieval with footnotes, page regions, and other checks that join several tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veridock.functions import quantity as q
from veridock.functions import textnorm as t
from veridock.operators import searching
from veridock.operators.rules import COVERED
from veridock.session import stored


def retrieved(queries: DataFrame, evidence: DataFrame, most: int = 15) -> DataFrame:
    """For each query the citable items of its policy that share most search words (``searching.top_k``, of equal ones the first in
    the document), with the citable footnotes they link to. Queries and items without a policy find nothing,
    and footnotes are of a policy that is asked about.
    ``queries``: query_id (unique), policy_id, text; ``evidence``: evidence_id, document_id, ord, section,
    row_label, text, citable, linked_footnote_ids."""
    own = lambda c: F.transform(t.tokens(c), lambda w: F.concat_ws("\n", "document_id", w))  # noqa: E731  words of one policy meet no other's
    policies = queries.select(F.col("policy_id").alias("document_id")).distinct()
    live = evidence.where("citable").join(policies, "document_id", "left_semi")
    live = stored(live.select("evidence_id", "ord", "linked_footnote_ids", own(F.concat_ws(" ", "section", "row_label", "text")).alias("words")))
    items = live.select(F.struct("ord", "evidence_id").alias("item"), "words")
    asked = queries.where("policy_id is not null").withColumn("document_id", F.col("policy_id")).select("query_id", own(F.col("text")).alias("asked"))
    top = searching.top_k(asked, items, "query_id", "asked", "item", "words", most).select("query_id", "item.evidence_id")
    notes = top.join(live.select("evidence_id", F.explode("linked_footnote_ids").alias("note")), "evidence_id").select("query_id", F.col("note").alias("evidence_id"))
    return top.unionByName(notes).distinct().join(live, "evidence_id").select("query_id", "evidence_id", "ord")


def cells_of(claims: DataFrame, cells: DataFrame, mentions: DataFrame) -> DataFrame:
    """The coverage cells that a statement is about: the one it names, else those of the exposures it mentions.
    ``claims``: claim_id, policy_id, match_id; ``mentions``: id, exposure_id."""
    named = claims.join(cells, ["policy_id", "match_id"]).select("claim_id", "match_id", "exposure_id")
    rest = claims.join(named.select("claim_id"), "claim_id", "left_anti").select("claim_id", "policy_id")
    spoken = rest.join(mentions.select(F.col("id").alias("claim_id"), "exposure_id"), "claim_id").join(cells, ["policy_id", "exposure_id"]).select("claim_id", "match_id", "exposure_id")
    return named.unionByName(spoken)


def selection_errors(selections: DataFrame, compared: DataFrame, exposures: DataFrame, evidence: DataFrame, variants: DataFrame) -> DataFrame:
    """(run_id, error) of every rule a selection breaks: the compared set, the selected policy, its evidence, exposures,
    variant and add-ons."""
    err = lambda df, e: df.select("run_id", (F.lit(e) if isinstance(e, str) else e).alias("error"))
    runs = compared.groupBy("run_id").agg(F.array_sort(F.collect_set("policy_id")).alias("_run"))
    s = selections.join(runs, "run_id", "left")
    out = err(s.where(F.coalesce(F.array_sort("compared_policy_ids") != F.col("_run"), F.lit(True))), "compared set differs")
    out = out.unionByName(err(s.where(~F.coalesce(F.array_contains("_run", F.col("selected_policy_id")), F.lit(False))), "selected policy not compared"))
    cited = s.select("run_id", "_run", "selected_policy_id", F.explode("supporting_evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", "document_id", "citable"), "evidence_id", "left")
    role = F.when(F.col("document_id").isNull(), "does not exist").when(~F.array_contains("_run", F.col("document_id")), "is of another policy").when(~F.col("citable"), "is not citable")
    out = out.unionByName(err(cited.where(role.isNotNull()), F.concat_ws(" ", "evidence_id", role)))
    own = cited.where("document_id = selected_policy_id").select("run_id").distinct()
    out = out.unionByName(err(s.join(own, "run_id", "left_anti"), "no evidence of the selected policy"))
    out = out.unionByName(err(s.where(F.size("supporting_quotes") == 0), "no quote"))
    asked = s.select("run_id", F.explode("relevant_exposure_ids").alias("exposure_id"))
    out = out.unionByName(err(asked.join(exposures.select("run_id", "exposure_id"), ["run_id", "exposure_id"], "left_anti"), F.concat(F.lit("unknown exposure "), "exposure_id")))
    known = variants.select(F.col("policy_id").alias("selected_policy_id"), t.canonical("variant").alias("_v"))
    chosen = s.where("selected_variant is not null").withColumn("_v", t.canonical("selected_variant"))
    out = out.unionByName(err(chosen.join(known, ["selected_policy_id", "_v"], "left_anti"), "unknown variant"))
    addons = s.select("run_id", F.col("selected_policy_id").alias("document_id"), F.explode("required_addons").alias("addon")).withColumn("_a", t.normalised("addon"))
    shown = evidence.select("document_id", t.normalised(F.concat_ws(" ", "section", "row_label", "text")).alias("_t"))
    stated = addons.join(shown, "document_id").where(F.contains("_t", F.col("_a"))).select("run_id", "addon").distinct()
    return out.unionByName(err(addons.join(stated, ["run_id", "addon"], "left_anti"), F.concat(F.lit("add-on not in evidence: "), "addon")))


def point_problems(points: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """What is wrong with slide points: undocumented record, changed numbers, dropped words, a product named, no basis,
    unknown exposures, numbers the facts do not have; and only the first point of a record stays. ``points`` has the
    joined texts: point_id, record_id, record_fact (null if undocumented), capability_text, link_text, required (array),
    basis_values (array), unknown_exposures (array), and the parsed numbers capability_numbers, record_numbers, link_numbers,
    basis_numbers."""
    fails = lambda c: ~c.isin("PASS", "NA")
    dropped = F.filter("required", lambda w: ~F.contains(F.lower("capability_text"), w))
    both = t.normalised(F.concat_ws(" ", "capability_text", "link_text"))
    rules = [
        F.when(fails(q.number_check(F.col("capability_numbers"), F.col("record_numbers"))), "changes a number"),
        F.when(F.size(dropped) > 0, F.concat(F.lit("keep "), F.array_join(dropped, ", "))),
        F.when(F.size(t.names(aliases, both)) > 0, "names a product"),
        F.when(F.size("basis_values") == 0, "needs company facts"),
        F.when(F.size("unknown_exposures") > 0, "unknown exposures"),
        F.when(fails(q.number_check(F.col("link_numbers"), F.col("basis_numbers"))), "number not in the facts"),
    ]
    problems = F.when(F.col("record_fact").isNull(), F.array(F.lit("not a documented capability"))).otherwise(F.array_compact(F.array(*rules)))
    again = F.row_number().over(W.partitionBy("record_id").orderBy("point_id")) > 1
    return points.select("point_id", "record_id", problems.alias("problems"), again.alias("repeated")).withColumn("kept", (F.size("problems") == 0) & ~F.col("repeated"))


def deck_errors(decks: DataFrame, selections: DataFrame) -> DataFrame:
    """Decks whose recommended policy or variant is not the selected one."""
    rows = decks.join(selections.select("run_id", "selected_policy_id", "selected_variant"), "run_id", "left")
    wrong = F.when(F.col("selected_policy_id").isNull(), "no selection").when(F.col("policy_id") != F.col("selected_policy_id"), "other policy").when(~t.canonical(F.coalesce("variant", F.lit(""))).eqNullSafe(t.canonical(F.coalesce("selected_variant", F.lit("")))), "other variant")
    return rows.select("run_id", wrong.alias("error")).where("error is not null")


def edited(claims: DataFrame, edits: DataFrame, order: str = "at") -> DataFrame:
    """Statements with the last edit of each: new text, state DIRTY, marked as edited."""
    last = edits.withColumn("_n", F.row_number().over(W.partitionBy("claim_id").orderBy(F.desc(order)))).where("_n = 1").select("claim_id", F.col("text").alias("_text"))
    rows = claims.join(last, "claim_id", "left")
    return rows.select(*[c for c in claims.columns if c not in ("text", "state")], F.coalesce("_text", "text").alias("text"), F.when(F.col("_text").isNotNull(), "DIRTY").otherwise(F.col("state")).alias("state"), F.col("_text").isNotNull().alias("edited"))


def overridden(selections: DataFrame, overrides: DataFrame) -> DataFrame:
    """Selections after an advisor's override: the policy must have been compared and a reason given; variant and add-ons stay
    only if the policy does."""
    o = overrides.select("run_id", F.col("policy_id").alias("_p"), F.col("reason").alias("_r"))
    rows = selections.join(o, "run_id", "left")
    valid = F.coalesce(F.array_contains("compared_policy_ids", F.col("_p")) & (F.trim("_r") != ""), F.lit(False))
    same = F.col("_p") == F.col("selected_policy_id")
    return rows.select("run_id", "compared_policy_ids", F.when(valid, F.col("_p")).otherwise(F.col("selected_policy_id")).alias("selected_policy_id"), F.when(~valid | same, F.col("selected_variant")).alias("selected_variant"), F.when(~valid | same, F.col("required_addons")).otherwise(F.array().cast("array<string>")).alias("required_addons"), F.when(valid, "advisor").otherwise(F.col("decided_by")).alias("decided_by"), valid.alias("overridden"))


def limitation_topup(cells: DataFrame, kinds: list[str], wanted: int, existing: DataFrame) -> DataFrame:
    """Limitations to show, by kind in the given order, then row, then place, without those already there, up to ``wanted``
    in a run. ``cells``: run_id, row, place, kind, text; ``existing``: run_id, text."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    rows = cells.where(F.col("kind").isin(kinds)).withColumn("_key", t.normalised("text"))
    rows = rows.join(existing.select("run_id", t.normalised("text").alias("_key")), ["run_id", "_key"], "left_anti")
    first = rows.withColumn("_k", rank).withColumn("_n", F.row_number().over(W.partitionBy("run_id", "_key").orderBy("_k", "row", "place"))).where("_n = 1")
    return first.withColumn("ord", F.row_number().over(W.partitionBy("run_id").orderBy("_k", "row", "place"))).where(F.col("ord") <= wanted).select("run_id", "row", "place", "kind", "text", "ord")


def in_region(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """Text spans whose centre lies in a region of their page, in reading order; a superscript with no text of its own goes
    to the nearest line by height. ``spans``: page, x0, y0, x1, y1, text, superscript."""
    r = regions.select(F.col("page"), F.col("region_id"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = spans.join(r, "page").where(cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_y0"), F.col("_y1"))).withColumn("cy", cy)
    lines = inside.where("not superscript").select("page", "region_id", F.col("cy").alias("line_y")).distinct()
    marks = inside.where("superscript").join(lines, ["page", "region_id"]).withColumn("_n", F.row_number().over(W.partitionBy("page", "region_id", "x0", "cy", "text").orderBy(F.abs(F.col("cy") - F.col("line_y")), "line_y"))).where("_n = 1")
    plain = inside.where("not superscript").withColumn("line_y", F.col("cy"))
    cols = ["page", "region_id", "line_y", "x0", "text", "superscript"]
    return plain.select(*cols).unionByName(marks.select(*cols))


def limits_kept(rows: DataFrame, group: str, kind: str, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """(group, kind, n) whose count is outside its bounds; kinds that are missing count as 0."""
    n = rows.groupBy(group, kind).count()
    grid = rows.select(group).distinct().crossJoin(rows.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in bounds.items()], f"{kind} string, low int, high int"))  # bounds are a closed list
    both = grid.join(n, [group, kind], "left").withColumn("n", F.coalesce("count", F.lit(0)))
    return both.where((F.col("n") < F.col("low")) | (F.col("n") > F.col("high"))).select(group, kind, "n")


def document_id(names: Column, folder: Column, sha: Column, bundled: dict[str, str], home: str) -> Column:
    """The fixed id of a bundled file in its folder, else one made from the content hash."""
    out = F.concat(F.lit("POL-UPL-"), F.upper(F.left(sha, F.lit(6))))
    for file, key in bundled.items():
        out = F.when((names == file) & (folder == home), key).otherwise(out)
    return out


def attention(items: DataFrame, by: str = "run_id") -> DataFrame:
    """What an advisor is told: numbers of blocking and open items, and the message that goes with them."""
    n = items.groupBy(by).agg(F.count_if(F.col("kind") == "fail").alias("n_blocking"), F.count_if(F.col("kind") == "review").alias("n_review"))
    return n.withColumn("message", F.when(F.col("n_blocking") > 0, F.concat("n_blocking", F.lit(" statement(s) must be changed"))).when(F.col("n_review") > 0, F.concat("n_review", F.lit(" item(s) to review"))).otherwise("Ready"))


def unavailable(selections: DataFrame, cells: DataFrame) -> DataFrame:
    """(run_id, match_id) of the selected policy's cells for the relevant exposures that are covered by status, but do not hold at
    the sum insured. ``cells``: run_id, match_id, exposure_id, policy_id, status, available."""
    asked = selections.select("run_id", F.col("selected_policy_id").alias("policy_id"), F.explode(F.array_distinct("relevant_exposure_ids")).alias("exposure_id"))
    return cells.where(F.col("status").isin(*COVERED) & ~F.col("available")).join(asked, ["run_id", "policy_id", "exposure_id"], "left_semi").select("run_id", "match_id")
