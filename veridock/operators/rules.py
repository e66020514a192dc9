"""Rule cascades: severity lattice, gates, coverage cells, exposures, advisor actions, incremental work."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructField, StructType

from veridock.functions import textnorm as t
from veridock.session import stored

# Fixed values.
SEVERITY = {"VERIFIED": 0, "VERIFIED_WITH_QUALIFIER": 1, "NEEDS_REVIEW": 2, "UNSUPPORTED": 3, "CONTRADICTED": 4}
FAILING = ("UNSUPPORTED", "CONTRADICTED")
COVERED = ("FULLY_COVERED", "COVERED_WITH_LIMITATIONS", "COVERED_VIA_ADDON")
FAMILY = {"ADDON_REQUIRED": "ADDON", "OPTIONAL_EXTRA_PREMIUM": "ADDON"}


def _cases(column: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def severity(status: Column) -> Column:
    """Place in the lattice; statuses outside it count as 0."""
    return _cases(status, SEVERITY, 0)


def capped(status: Column, checks: Column) -> Column:
    """The status after checks (array of statuses they cap at): the most severe of all; a check never raises it."""
    worst = F.array_max(F.transform(checks, severity))
    names = F.array(*[F.lit(s) for s in SEVERITY])
    return F.when(F.coalesce(worst, F.lit(0)) > severity(status), F.element_at(names, worst + 1)).otherwise(status)


def with_qualifier(status: Column, qualifier: Column) -> Column:
    return F.when((status == "VERIFIED") & (F.length(qualifier) > 0), "VERIFIED_WITH_QUALIFIER").otherwise(status)


def qualifier(parts: Sequence[Column]) -> Column:
    """Qualifiers joined, each once, in order."""
    return F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))), "; ")


def rendered(state: Column, status: Column) -> Column:
    """A statement that is shown: not removed, and with a result that does not fail."""
    return (state != "REMOVED") & F.coalesce(~status.isin(*FAILING), F.lit(False))


def covered(status: Column, is_available: Column) -> Column:
    return status.isin(*COVERED) & is_available


def repairable(status: Column, state: Column, slide: Column, attempts: Column, edited: Column, kind: Column) -> Column:
    return status.isin(*FAILING) & (state != "REMOVED") & (slide != 2) & (attempts == 0) & ~edited & ~kind.isin("CAPABILITY_STATEMENT", "NON_FACTUAL")


def summary(results: DataFrame, by: Sequence[str], status: str, live: Column) -> DataFrame:
    """Counts by status over live statements, unrounded confidence and overall flag, one row per group."""
    rows = results.where(live)
    s = F.col(status)
    good, counted = s.isin("VERIFIED", "VERIFIED_WITH_QUALIFIER"), ~s.isin("NON_FACTUAL", "LABELLED_ASSUMPTION")
    flag = F.when(F.bool_or(s.isin(*FAILING)), "FAIL").when(F.bool_or(s == "NEEDS_REVIEW"), "REVIEW_REQUIRED").otherwise("PASS")
    return rows.groupBy(*by).agg(*[F.count_if(s == name).alias(f"n_{name.lower()}") for name in SEVERITY], (F.count_if(good) / F.nullif(F.count_if(counted), F.lit(0))).alias("confidence"), flag.alias("flag"))


def gate_items(rows: DataFrame, key: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(key, item_id, kind, ord) of all rules (name, kind, condition) that hold; one pass over the rows."""
    hits = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("item_id"), F.lit(kind).alias("kind"), F.lit(i).alias("ord"))) for i, (name, kind, c) in enumerate(rules)])
    return rows.select(key, F.explode(F.array_compact(hits)).alias("i")).select(key, "i.item_id", "i.kind", "i.ord")


def gate(items: DataFrame, acknowledged: DataFrame, by: str) -> DataFrame:
    """Flag of each run and whether it may be exported: nothing fails and nothing unacknowledged is left to review."""
    known = acknowledged.select(by, "item_id").distinct().withColumn("_ack", F.lit(True))
    all_items = items.join(known, [by, "item_id"], "left")
    fails, reviews = F.col("kind") == "fail", F.col("kind") == "review"
    flag = F.when(F.bool_or(fails), "FAIL").when(F.bool_or(reviews), "REVIEW_REQUIRED").otherwise("PASS")
    left = F.count_if(reviews & F.col("_ack").isNull())
    return all_items.groupBy(by).agg(flag.alias("flag"), F.count_if(fails).alias("n_fail"), left.alias("n_open"), ((F.count_if(fails) == 0) & (left == 0)).alias("export_allowed"))


def latest(events: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event of each target: state derived from an append-only log."""
    return events.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")


def validated_cells(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Coverage cells from drafts.

    ``drafts``: cell_id, policy_id, status, limits (array of struct<kind, ids, quoted>), benefit_ids, exclusion_ids,
    quote_ids. ``evidence``: evidence_id, document_id, citable, tier, excludes (it reads as an exclusion), benefit (it reads
    as a benefit). Each rule sees the status that the rules before it left, so each is a column of its own; errors make the
    cell NOT_STATED, corrections are notes."""
    cited = drafts.select("cell_id", "policy_id", F.explode_outer(F.array_distinct(F.flatten(F.array("benefit_ids", "exclusion_ids", "quote_ids", F.flatten(F.transform("limits", lambda x: x["ids"])))))).alias("evidence_id"))
    seen = cited.join(evidence, "evidence_id", "left")
    good = F.coalesce((F.col("document_id") == F.col("policy_id")) & F.col("citable"), F.lit(False))
    problem = F.when(F.col("document_id").isNull(), "unknown").when(F.col("document_id") != F.col("policy_id"), "foreign").when(~F.col("citable"), "not citable")
    facts = seen.where("evidence_id is not null").groupBy("cell_id").agg(
        F.array_sort(F.collect_list(F.when(problem.isNotNull(), F.concat(F.col("evidence_id"), F.lit(": "), problem)))).alias("bad"),
        F.collect_set(F.when(good, F.col("evidence_id"))).alias("good"),
        F.collect_set(F.when(good & (F.col("tier") == "BASE"), F.col("evidence_id"))).alias("base"),
        F.collect_set(F.when(good & F.col("tier").isin("ADDON", "OPTIONAL"), F.col("evidence_id"))).alias("addon"),
        F.collect_set(F.when(good & (F.col("tier") == "OPTIONAL"), F.col("evidence_id"))).alias("optional"),
        F.collect_set(F.when(good & F.col("excludes"), F.col("evidence_id"))).alias("excluding"),
        F.collect_set(F.when(good & F.col("benefit"), F.col("evidence_id"))).alias("benefits"),
    )
    none = F.array().cast("array<string>")
    d = drafts.join(facts, "cell_id", "left")
    d = d.select(*drafts.columns, *[F.coalesce(F.col(c), none).alias(c) for c in ("bad", "good", "base", "addon", "optional", "excluding", "benefits")])
    has = lambda a, b: F.arrays_overlap(F.col(a), F.col(b))
    kinds = F.transform("limits", lambda x: x["kind"])
    fields = drafts.schema["limits"].dataType.elementType.names
    defining = lambda x: x["kind"].isin("OTHER_CONDITION", "SUBLIMIT") & x["defines"] if "defines" in fields else F.lit(False)
    d = d.withColumn("kept", F.filter("limits", lambda x: ~defining(x) & ((x["kind"] != "OTHER_CONDITION") | x["quoted"])))
    if "variants" in drafts.columns and "variant" in evidence.columns:
        # a limit to one variant is none if the cited items have them all
        canonical = lambda c: F.array_distinct(F.transform(c, t.canonical))
        of_limits = d.select("cell_id", F.explode(F.array_union("benefit_ids", F.flatten(F.transform("kept", lambda x: x["ids"])))).alias("evidence_id")).join(evidence.select("evidence_id", "variant"), "evidence_id").groupBy("cell_id").agg(F.collect_set("variant").alias("seen_variants"))
        d = d.join(of_limits, "cell_id", "left")
        all_there = (F.size("variants") > 0) & (F.size(F.array_except(canonical(F.col("variants")), canonical(F.coalesce("seen_variants", none)))) == 0)
        d = d.withColumn("kept", F.transform("kept", lambda x: x.withField("kind", F.when(all_there & (x["kind"] == "VARIANT_ONLY"), "SUBLIMIT").otherwise(x["kind"]))))
    is_covered = F.col("status").isin(*COVERED)
    rules = [
        F.when(F.size(F.array_intersect("quote_ids", "good")) == 0, "no verified quote"),
        F.when((F.col("status") == "EXCLUDED") & ~has("exclusion_ids", "excluding"), "no exclusion evidence"),
        F.when(is_covered & ~has("benefit_ids", "benefits"), "no benefit evidence"),
        F.when((F.col("status") == "COVERED_WITH_LIMITATIONS") & (F.size("limits") == 0), "no limitation"),
        F.when((F.col("status") == "COVERED_VIA_ADDON") & has("benefit_ids", "addon") & ~F.exists(kinds, lambda k: k.isin(*FAMILY)), "no add-on limitation"),
    ]
    d = d.withColumn("errors", F.when(F.col("status") == "NOT_STATED", none).otherwise(F.concat("bad", F.array_compact(F.array(*rules)))))
    ok = F.size("errors") == 0
    full, limited = F.lit("FULLY_COVERED"), F.lit("COVERED_WITH_LIMITATIONS")
    # a cover that a base item states is not only an add-on: limitations that rest on add-on items alone go
    rests = lambda x: x["kind"].isin(*FAMILY) & (F.size(x["ids"]) > 0) & (F.size(F.array_except(x["ids"], F.col("addon"))) == 0)
    d = d.withColumn("s1", F.when(ok, F.col("status")).otherwise("NOT_STATED"))
    optional = F.col("s1").isin(*COVERED) & has("benefit_ids", "base")
    d = d.withColumn("k1", F.when(optional, F.filter("kept", lambda x: ~rests(x))).otherwise(F.col("kept")))
    gone = F.size("k1") < F.size("kept")
    no_addon = ~F.exists("k1", lambda x: x["kind"].isin(*FAMILY))
    empty = F.size("k1") == 0
    d = d.withColumn("s2", F.when((F.col("s1") == "COVERED_VIA_ADDON") & gone & no_addon, F.when(empty, full).otherwise(limited)).otherwise(F.col("s1")))
    d = d.withColumn("s3", F.when((F.col("s2") == "COVERED_WITH_LIMITATIONS") & empty & (F.size("limits") > 0), full).otherwise(F.col("s2")))
    d = d.withColumn("s4", F.when((F.col("s3") == "COVERED_VIA_ADDON") & ~has("benefit_ids", "addon"), F.when(empty, full).otherwise(limited)).otherwise(F.col("s3")))
    only_addon = F.col("s4").isin(*COVERED) & has("benefit_ids", "addon") & ~has("benefit_ids", "base")
    d = d.withColumn("s5", F.when(only_addon, "COVERED_VIA_ADDON").otherwise(F.col("s4")))
    d = d.withColumn("s6", F.when((F.col("s5") == "FULLY_COVERED") & ~empty, limited).otherwise(F.col("s5")))
    note = lambda a, b, text: F.when(F.col(a) != F.col(b), F.lit(text))
    notes = [F.when(ok & (F.size("kept") < F.size("limits")), "condition without a quote dropped"), note("s1", "s2", "a base item covers it"), note("s2", "s3", "no limitation left"), note("s3", "s4", "no add-on evidence"), note("s4", "s5", "only add-on evidence"), note("s5", "s6", "has limitations")]
    stated = F.col("status") != "NOT_STATED"
    # cover by add-on or optional items alone says so among its limitations
    kept_kinds = F.transform("k1", lambda x: x["kind"])
    of_tier = {"ADDON_REQUIRED": F.size(F.array_intersect("benefit_ids", F.array_except("addon", "optional"))) > 0, "OPTIONAL_EXTRA_PREMIUM": has("benefit_ids", "optional")}
    more = F.array_compact(F.array(*[F.when(only_addon & holds & ~F.array_contains(kept_kinds, kind), F.lit(kind)) for kind, holds in of_tier.items()]))
    return d.select("cell_id", "policy_id", F.col("s6").alias("status"), ok.alias("validated"), "errors", F.when(ok & stated, F.array_compact(F.array(*notes))).otherwise(none).alias("notes"), F.when(ok & stated, F.concat(kept_kinds, more)).otherwise(none).alias("limitations"))


#: Fields that say too little about a company to base an exposure on.
GENERIC_FIELDS = ("industry", "size", "headcount_band")


def selected_exposures(picks: DataFrame, taxonomy: DataFrame, facts: DataFrame, most: int = 8) -> DataFrame:
    """The exposures of each run: run_id, exposure_id, place, baseline, basis, assumption_based. Picks must be known, are taken
    once, in order, and keep the facts that exist and are no business risk; a pick without one is dropped. Baseline
    exposures come first, picked or not: a baseline that is not picked rests on the facts about size. A baseline is
    assumption-based if all its facts are, another one if all those are that say more than industry and size, also
    with none. At most ``most`` stay. ``picks``: run_id, ord, exposure_id, fact_ids; ``taxonomy`` (a closed list):
    exposure_id, ord, baseline; ``facts``: run_id, fact_id, ord, field, status."""
    known = F.broadcast(taxonomy.select("exposure_id", F.col("ord").alias("entry"), "baseline"))
    rows = picks.join(known, "exposure_id").select("run_id", "exposure_id", "entry", "baseline", "ord", F.posexplode(F.array_distinct("fact_ids")).alias("at", "fact_id"))
    good = rows.join(facts.where("field <> 'business_risk'").select("run_id", "fact_id", "field", "status"), ["run_id", "fact_id"])
    first = good.withColumn("least", F.min("ord").over(W.partitionBy("run_id", "exposure_id"))).where("ord = least")
    size = facts.where(F.col("field").isin("size", "headcount_band")).select("run_id", F.col("ord").alias("at"), "fact_id", "field", "status")
    runs = facts.select("run_id").distinct().crossJoin(known.where("baseline"))  # a closed list of a few entries
    missing = runs.join(first.select("run_id", "exposure_id").distinct(), ["run_id", "exposure_id"], "left_anti").join(size, "run_id", "left").select("run_id", "exposure_id", "entry", "baseline", F.lit(0).alias("ord"), "at", "fact_id", "field", "status")
    every = first.select(*missing.columns).unionByName(missing)
    assumed, counts = F.col("status") == "ASSUMPTION", F.col("baseline") | ~F.col("field").isin(*GENERIC_FIELDS)
    g = every.groupBy("run_id", "exposure_id", "entry", "baseline", "ord").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("fact_id").isNotNull(), F.struct("at", "fact_id")))), lambda x: x["fact_id"]).alias("basis"), F.count_if(counts & ~assumed & F.col("fact_id").isNotNull()).alias("solid"))
    order = F.when(F.col("baseline"), F.col("entry")).otherwise(F.col("ord"))
    place = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("baseline"), order, "exposure_id"))
    return g.select("run_id", "exposure_id", place.alias("place"), "baseline", "basis", (F.col("solid") == 0).alias("assumption_based")).where(F.col("place") <= most)


def merged_labels(items: DataFrame, answers: DataFrame, variants: Sequence[str], longest: int = 80) -> DataFrame:
    """Items with labels that a model gave: the first answer for an id counts, only for fields still empty; variants must be
    known, conditions short."""
    first = answers.withColumn("_n", F.row_number().over(W.partitionBy("evidence_id").orderBy("ord"))).where("_n = 1")
    new = first.select("evidence_id", F.when(F.col("variant").isin(*variants), F.col("variant")).alias("_variant"), F.when(F.length("si_condition") <= longest, F.col("si_condition")).alias("_si"), F.col("tier").alias("_tier"))
    joined = items.join(new, "evidence_id", "left")
    return joined.select(*[c for c in items.columns if c not in ("variant", "si_condition", "tier")], F.coalesce("variant", "_variant").alias("variant"), F.coalesce("si_condition", "_si").alias("si_condition"), F.coalesce(F.nullif("tier", F.lit("UNKNOWN")), "_tier", F.lit("UNKNOWN")).alias("tier"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old rows in their order with those of ``new`` in their place, then what is only in ``new``."""
    values = [c for c in old.columns if c not in (key, order)]
    o = old.select(key, F.col(order).alias("_o"), F.struct(*values).alias("_old"))
    n = new.select(key, F.col(order).alias("_n"), F.struct(*values).alias("_new"))
    both = o.join(n, key, "full")
    merged = both.select(key, F.coalesce("_new", "_old").alias("v"), F.col("_o").isNull().cast("int").alias("_late"), F.coalesce("_o", "_n").alias(order))
    return merged.select(key, *[F.col(f"v.{c}").alias(c) for c in values], F.col("_late").alias("appended"), order)


def changed(now: DataFrame, before: DataFrame, key: str, view: Sequence[str]) -> DataFrame:
    """Keys of ``now`` that are new or whose view differs from ``before``; removed keys are not reported."""
    b = before.select(key, F.struct(*view).alias("_before"), F.lit(True).alias("_there"))
    rows = now.select(key, F.struct(*view).alias("_now")).join(b, key, "left")
    kind = F.when(F.col("_there").isNull(), "new").when(~F.col("_now").eqNullSafe(F.col("_before")), "changed")
    return rows.select(key, kind.alias("change")).where("change is not null")


def stale(cached: DataFrame, current: DataFrame, by: str, item: str, all_stale: Column | None = None) -> DataFrame:
    """Cells with an item whose hash is not the recorded one (or is gone), or all if a common input changed."""
    now = current.select(item, F.col("hash").alias("_now"))
    differs = ~F.col("hash").eqNullSafe(F.col("_now"))
    return cached.join(now, item, "left").groupBy(by).agg(F.bool_or(differs | (all_stale if all_stale is not None else F.lit(False))).alias("stale"))


def carried_over(results: DataFrame, previous: DataFrame, key: str, fields: Sequence[str], history: Sequence[str]) -> DataFrame:
    """New results; where all ``fields`` equal the previous ones, the previous row's history stays."""
    p = previous.select(key, F.struct(*fields).alias("_p"), F.struct(*history).alias("_h"))
    rows = results.join(p, key, "left")
    same = F.coalesce(F.struct(*fields).eqNullSafe(F.col("_p")), F.lit(False)) & F.col("_p").isNotNull()
    return rows.select(key, *fields, *[F.when(same, F.col(f"_h.{h}")).otherwise(F.col(h)).alias(h) for h in history], same.alias("carried"))


def without(claims: DataFrame, gone: DataFrame) -> DataFrame:
    """Claims without the removed ones, what frames them and, if a benefit goes, its row; numbered anew."""
    ids = gone.select("claim_id").distinct()
    framed = claims.join(ids.select(F.col("claim_id").alias("frames")), "frames", "left_semi").select("claim_id")
    rows = claims.join(ids, "claim_id", "left_semi").where("slot = 'benefit' and row_id is not null").select("row_id").distinct()
    left = claims.join(ids.unionByName(framed), "claim_id", "left_anti").join(rows, "row_id", "left_anti")
    return left.withColumn("new_id", F.concat(F.lit("CL-"), F.lpad(F.row_number().over(W.partitionBy("run_id").orderBy("ord")).cast("string"), 3, "0")))


def first_of_each(drafts: DataFrame, taxonomy: DataFrame, key: str, order: str) -> DataFrame:
    """Every entry of the taxonomy with its first draft; those without one are NOT_STATED and not validated."""
    first = drafts.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    values = [c for c in drafts.columns if c not in (key, "status")]
    return taxonomy.join(first, key, "left").select(*taxonomy.columns, F.coalesce("status", F.lit("NOT_STATED")).alias("status"), F.col("status").isNotNull().alias("validated"), *values)


def linked(items: DataFrame, notes: DataFrame, by: str, marker: str, order: str, shape: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """Items with the ids of the notes that have one of their markers, in order, each once. ``items`` has an array of
    markers. Notes are looked up once for all items of the same markers; ``shape`` is applied to each such list, not to each item."""
    sets = items.select(by, marker).distinct().select(by, F.col(marker).alias("_set"), F.posexplode(marker).alias("_p", "marker"))
    ids = sets.join(notes.select(by, "marker", F.col("id").alias("_note"), F.col(order).alias("_o")), [by, "marker"])
    found = ids.groupBy(by, "_set").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_o", "_note"))), lambda x: x["_note"])).alias("linked"))
    none = F.array().cast(found.schema["linked"].dataType)
    lists = found.select(by, F.col("_set").alias(marker), shape(F.col("linked")).alias("linked"))
    return items.join(lists, [by, marker], "left").select(*items.columns, F.coalesce("linked", shape(none)).alias("linked"))


def peers(items: DataFrame, scope: str) -> DataFrame:
    """(evidence_id, peer): the items that an item's context is read from. ``row``: those of its page, table and row label;
    ``section``: those of its page and section; ``item``, or without a row label: itself."""
    own = items.select("evidence_id", F.col("evidence_id").alias("peer"))
    if scope == "item":
        return own
    by = ["document_id", "page", *(["table_id", "row_label"] if scope == "row" else ["section"])]
    grouped = items.where("row_label is not null") if scope == "row" else items
    keyed = grouped.select("evidence_id", F.xxhash64(*by).alias("_k"), *by)
    other = keyed.select(F.col("evidence_id").alias("peer"), F.col("_k"), *[F.col(c).alias(f"_{c}") for c in by])
    same = keyed.join(other, "_k")
    for c in by:
        same = same.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
    found = same.select("evidence_id", "peer")
    return found.unionByName(own.join(found, "evidence_id", "left_anti"))


def cache_state(asked: DataFrame, cached: DataFrame, by: str, key: str, now: Column, most_days: int) -> DataFrame:
    """HIT, STALE (made with another key, or too old) or MISS for each entry asked for. ``cached``: by, key, fetched."""
    rows = asked.select(by).distinct().join(cached, by, "left")
    old = now - F.col("fetched") > F.make_dt_interval(days=F.lit(most_days))
    return rows.select(by, F.when(F.col("key").isNull(), "MISS").when((F.col("key") != key) | old, "STALE").otherwise("HIT").alias("state"))


def uncached(files: DataFrame, known: DataFrame, version: str) -> DataFrame:
    """Files with whether they still are work: no extraction of this version is known for their content."""
    done = known.where(F.col("extraction_version") == version).select("sha256").distinct().withColumn("_done", F.lit(True))
    return files.join(done, "sha256", "left").withColumn("work", F.col("_done").isNull()).drop("_done")


#: Steps that are summed up at once, and the most of a run that is.
AT_ONCE, WHOLE = 50_000, 200_000


def _calls_inside(parent: np.ndarray, calls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calls of steps and all inside them, by paths that double, and the steps whose path never ends; ``parent``: places, -1 for none."""
    at, sums = parent.copy(), calls.copy()
    for _ in range(len(parent).bit_length() + 1):
        going = np.flatnonzero(at >= 0)
        if not len(going):
            break
        more = sums[going]
        np.add.at(sums, at[going], more)
        at[going] = at[at[going]]
    return sums, at >= 0


def _summed_up(steps: pa.Table) -> pa.Table:
    """Whole runs, with the calls of all steps inside a step."""
    n = len(steps)
    run = steps.column("run_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    named = pa.chunked_array([*steps.column("step").chunks, *steps.column("parent").chunks]).combine_chunks().dictionary_encode().indices
    known, names = named.is_valid().to_numpy(zero_copy_only=False), named.fill_null(0).to_numpy(zero_copy_only=False)
    keys = (np.tile(run.astype(np.int64) + 1, 2) * (2 * n + 1)) + np.where(known, names, 2 * n)
    order = np.argsort(keys[:n], kind="stable")
    place = np.minimum(np.searchsorted(keys[:n], keys[n:], sorter=order), n - 1)
    parent = np.where(known[n:] & (keys[order[place]] == keys[n:]), order[place], -1)
    calls = steps.column("calls").cast(pa.int64()).fill_null(0).to_numpy()
    sums, lost = _calls_inside(parent, calls)
    if lost.any():
        sums, _ = _calls_inside(np.where(lost, -1, parent), calls)
    return steps.set_column(steps.column_names.index("calls"), "calls", pa.array(sums))


def rolled_up(steps: DataFrame) -> DataFrame:
    """Steps with the calls of all steps inside them, however deep; ``steps``: run_id, step, parent, seconds, calls.

    Many runs are summed up together, each as a whole, so the steps are shuffled once. Runs of more than ``WHOLE`` steps are summed up by
    joins, see ``_doubled``. A parent that is not there counts as none. Steps whose parents run in a circle, and those
    below them, are in no tree: they have their own calls only."""
    steps = steps.withColumn("calls", F.col("calls").cast("long"))
    sizes = steps.groupBy("run_id").agg(F.count("*").alias("_n"))
    most = sizes.agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).first()
    rows, rest = steps, None
    if (most["most"] or 0) > WHOLE:
        long = stored(sizes.where(F.col("_n") > WHOLE).select(F.col("run_id").alias("_run")))
        rows, rest = (steps.join(long, F.col("run_id").eqNullSafe(F.col("_run")), how) for how in ("left_anti", "left_semi"))
    rows = rows.groupBy(F.pmod(F.xxhash64("run_id"), F.lit(max(1, -(-(most["n"] or 0) // AT_ONCE)))).alias("_bucket"))

    def run(table: pa.Table) -> pa.Table:
        return _summed_up(table)

    out = rows.applyInArrow(run, StructType([StructField(f.name, f.dataType) for f in steps.schema.fields]))
    return out if rest is None else out.unionByName(_doubled(stored(rest)))


def _doubled(steps: DataFrame) -> DataFrame:
    """``rolled_up`` of runs of any length, by joins.

    Paths double: after a round, ``at`` is a step's ancestor twice as far up, and its sum covers twice as many levels below it, since
    the levels that are new are those of the descendants just as far down as it reached. A chain of n steps takes log n rounds
    of two joins and a sum, and no step is ever paired with all of its ancestors."""
    own = steps.select("run_id", "step", "parent", "calls")
    there = own.select("run_id", F.col("step").alias("parent"), F.lit(True).alias("_there"))
    own = stored(own.join(there, ["run_id", "parent"], "left").select("run_id", "step", F.when(F.col("_there"), F.col("parent")).alias("parent"), F.col("calls").cast("long").alias("calls")))
    most = math.ceil(math.log2(max(2, own.count()))) + 1
    sums, round_ = own.select("run_id", "step", F.col("parent").alias("at"), "calls"), 0
    while not (going := sums.where("at is not null")).isEmpty():
        if round_ > most:
            lost = going.select("run_id", "step", F.lit(True).alias("_lost"))
            kept = own.join(lost, ["run_id", "step"], "left").select("run_id", "step", F.when(F.col("_lost").isNull(), F.col("parent")).alias("parent"), "calls")
            cut = _doubled(stored(kept).withColumn("seconds", F.lit(0.0)))
            return steps.drop("calls").join(cut.select("run_id", "step", "calls"), ["run_id", "step"]).select(*steps.columns)
        below = going.groupBy("run_id", "at").agg(F.sum("calls").alias("_more")).withColumnRenamed("at", "step")
        up = sums.select("run_id", F.col("step").alias("at"), F.col("at").alias("_next"))
        next_ = sums.join(up, ["run_id", "at"], "left").join(below, ["run_id", "step"], "left")
        sums, round_ = stored(next_.select("run_id", "step", F.col("_next").alias("at"), (F.col("calls") + F.coalesce("_more", F.lit(0))).alias("calls"))), round_ + 1
    return steps.drop("calls").join(sums.select("run_id", "step", "calls"), ["run_id", "step"]).select(*steps.columns)


def evaluated(rows: DataFrame, by: Sequence[str], least: float = 0.8) -> DataFrame:
    """False statements that did not pass, the share of true ones that did, and whether all of the first and enough of the second
    did. ``rows``: truth, status."""
    passed, true = F.col("status").isin("VERIFIED", "VERIFIED_WITH_QUALIFIER"), F.col("truth")
    g = rows.groupBy(*by).agg(F.count_if(~true & ~passed).alias("false_caught"), F.count_if(~true).alias("_false"), (F.count_if(true & passed) / F.nullif(F.count_if(true), F.lit(0))).alias("true_rate"))
    return g.withColumn("met", (F.col("false_caught") == F.col("_false")) & F.coalesce(F.col("true_rate") >= least, F.lit(False))).drop("_false")
