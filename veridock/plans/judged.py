"""Queries on where statements are judged, what holds a run back, and facts said to be from the web."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.functions import predicates as p
from veridock.functions import textnorm as t
from veridock.operators import audit, ordered, rules, selection
from veridock.plans.registry import query
from veridock.plans.text import _BOILER, _EDGES, _TOKENS, _norm
from veridock.session import spread, table
from veridock.sources import evidence

#: Words of the driver's texts that stand for the names of two products; a third is asked about and not known.
ALIASES = {"POL-A": ["that", "pas"], "POL-B": ["with", "est", "die"]}
_NAMED = " ".join(f"regexp_matches(s, '(^|[^a-z0-9])({'|'.join(a)})([^a-z0-9+]|$)') AS {k[-1].lower()}," for k, a in ALIASES.items())
_KINDS = ("POLICY_BENEFIT", "POLICY_LIMIT", "CAPABILITY_STATEMENT", "NON_FACTUAL", "COMPANY_FACT", "ASSUMPTION", "NON_FACTUAL")
_STATUSES = ("VERIFIED", "VERIFIED_WITH_QUALIFIER", "NEEDS_REVIEW", "UNSUPPORTED", "CONTRADICTED", "ADVISOR_ATTESTED")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as statements: every fourth states an amount, every fifth that something is not stated."""
    turns = spread(table(spark, sf_dir, "conversations")).withColumns({"c": F.coalesce("conv_id", F.lit(0)), "u": F.coalesce("turn", F.lit(0))})
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({at} % {len(values)} as int) + 1"))
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9]", "")
    text = F.when(F.expr("(c + u) % 13 = 0"), audit.NOT_STATED_TEXT).otherwise(F.concat(F.when(F.expr("(c * 3 + u) % 4 = 1"), "INR 500 in all. ").otherwise(""), said, F.when(F.expr("(c + u) % 5 = 2"), " It is not stated in the brochure.").otherwise("")))
    return turns.select(
        "conv_id", "turn", "role", F.struct("conv_id", "turn").alias("claim_id"), said.alias("said"), text.alias("text"), F.expr("cast(u % 4 + 1 as int)").alias("slide"), pick(_KINDS, "(c + u * 2)").alias("claim_type"),
        pick((None, "POL-A", "POL-Z", None), "c").alias("policy_id"), F.when(F.expr("c % 2 = 0"), "M-1").alias("match_id"), F.expr("cast((c + u * 3) % 2 as int)").alias("n_basis"), pick(_STATUSES, "(c * 5 + u)").alias("status"), F.expr("cast(u % 3 as int)").alias("n_repairs"),
    )


def _listed(values: tuple[str | None, ...], at: str) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][CAST({at} % {len(values)} AS INTEGER) + 1]"


_CLAIMS = f"""t AS (SELECT *, coalesce(conv_id, 0) AS c, coalesce(turn, 0) AS u, regexp_replace(coalesce(text, ''), '[0-9]', '', 'g') AS said FROM conversations),
 cl AS (SELECT conv_id, turn, role, c, u, said, u % 4 + 1 AS slide, {_listed(_KINDS, '(c + u * 2)')} AS kind, {_listed((None, 'POL-A', 'POL-Z', None), 'c')} AS policy_id, (c + u * 3) % 2 > 0 AS basis, {_listed(_STATUSES, '(c * 5 + u)')} AS status, u % 3 > 0 AS repaired,
   (c + u) % 13 = 0 AS silent_row, (c + u) % 13 <> 0 AND (c * 3 + u) % 4 = 1 AS numbered, (c + u) % 13 = 0 OR (c + u) % 5 = 2 AS silent, {_norm("CASE WHEN (c + u) % 13 = 0 THEN '' ELSE said END")} AS s FROM t),
 n AS (SELECT *, {_NAMED} FROM cl)"""


@query(f"""WITH {_CLAIMS}, k AS (SELECT *, coalesce(policy_id, CASE WHEN a AND NOT b THEN 'POL-A' WHEN b AND NOT a THEN 'POL-B' END) AS about, coalesce(about IN ('POL-A', 'POL-B'), false) AS audited FROM n),
 r AS (SELECT *, CASE WHEN slide = 2 AND kind NOT IN ('CAPABILITY_STATEMENT', 'NON_FACTUAL') THEN 'UNSUPPORTED' WHEN kind IN ('CAPABILITY_STATEMENT', 'COMPANY_FACT', 'ASSUMPTION') THEN NULL
   WHEN kind = 'NON_FACTUAL' THEN CASE WHEN basis THEN NULL WHEN NOT (numbered OR a OR b) THEN 'NON_FACTUAL' WHEN slide = 2 OR NOT audited THEN 'NEEDS_REVIEW' END WHEN NOT audited THEN 'UNSUPPORTED' END AS settled,
   CASE WHEN kind = 'CAPABILITY_STATEMENT' THEN 'records' WHEN kind = 'NON_FACTUAL' AND basis THEN 'link' WHEN kind = 'COMPANY_FACT' OR (kind = 'ASSUMPTION' AND basis) THEN 'company' WHEN kind = 'ASSUMPTION' THEN 'assumption' WHEN silent THEN 'not_stated' ELSE 'policy' END AS judge FROM k)
 SELECT conv_id, turn, CASE WHEN settled IS NULL THEN judge ELSE 'code' END AS route, CASE WHEN settled IS NULL AND judge IN ('policy', 'not_stated') THEN about END AS policy_id, settled AS status FROM r""")
def routed_statements(spark, sf_dir):
    """Where each turn, as a statement, is judged, and about which product: R7 R5 X5 F4 P9."""
    policies = spark.createDataFrame([(k,) for k in ALIASES], "policy_id string")
    return audit.routed(_claims(spark, sf_dir), policies, ALIASES).select("claim_id.*", "route", "policy_id", "status")


_CONNECTORS = ", ".join(f"'{w}'" for w in p.CONNECTORS)
_GATED = f"""{_CLAIMS}, sc AS (SELECT *, regexp_replace(said, '^ +| +$', '', 'g') AS core FROM n),
 g AS (SELECT *, len(regexp_split_to_array(core, '\\s+')) >= 5 AND regexp_matches(core, '^\\p{{Lu}}') AND regexp_matches(core, '[.!?]$') AND regexp_replace(lower(regexp_split_to_array(core, '\\s+')[1]), '^,+|,+$', '', 'g') NOT IN ({_CONNECTORS}) AS complete, coalesce(role = 'assistant', false) AS material FROM sc),
 live AS (SELECT * FROM g WHERE c % 7 <> 3),
 items AS (SELECT conv_id, turn, unnest([x FOR x IN [
  CASE WHEN status = 'CONTRADICTED' THEN 'CONTRADICTED fail' END, CASE WHEN status = 'UNSUPPORTED' AND material THEN 'UNSUPPORTED fail' END, CASE WHEN status = 'UNSUPPORTED' AND NOT material THEN 'UNSUPPORTED review' END,
  CASE WHEN (a OR b) AND status <> 'ADVISOR_ATTESTED' THEN 'POLICY_REFERENCE fail' END, CASE WHEN numbered AND status <> 'ADVISOR_ATTESTED' THEN 'NUMBER_CHECK fail' END, CASE WHEN slide = 2 AND kind NOT IN ('CAPABILITY_STATEMENT', 'NON_FACTUAL') THEN 'SLIDE2 fail' END,
  CASE WHEN NOT complete THEN 'DIRTY fail' END, CASE WHEN status = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW review' END, CASE WHEN status = 'VERIFIED_WITH_QUALIFIER' AND NOT coalesce(policy_id IS NOT NULL AND core <> '' AND length(core) <= 200 AND c % 2 = 0, false) THEN 'QUALIFIER_NOT_RENDERED review' END,
  CASE WHEN status = 'ADVISOR_ATTESTED' THEN 'ATTESTED review' END, CASE WHEN repaired AND status IN ('NEEDS_REVIEW', 'UNSUPPORTED', 'CONTRADICTED') THEN 'REPAIR_FAILED review' END] IF x IS NOT NULL]) AS item FROM live)"""


def _gate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = t.names(ALIASES, t.normalised(F.when(F.col("text") == audit.NOT_STATED_TEXT, "").otherwise(F.col("said"))))
    core = F.trim("said")
    rows = _claims(spark, sf_dir).withColumns({
        "state": F.when(F.expr("coalesce(conv_id, 0) % 7 = 3"), "REMOVED").when(p.complete_sentence(F.col("said")), "AUDITED").otherwise("DIRTY"),
        "material": F.coalesce(F.col("role") == "assistant", F.lit(False)),
        "failed": F.array_compact(F.array(F.when(F.size(named) > 0, "policy_name"), F.when((F.col("slide") == 2) & ~F.col("claim_type").isin("CAPABILITY_STATEMENT", "NON_FACTUAL"), "slide2"))),
        "number_failed": F.startswith("text", F.lit("INR 500 in all. ")),
        "qualifier_shown": audit.qualifier_shown(F.col("policy_id"), core, F.when(F.expr("coalesce(conv_id, 0) % 2 = 0"), core)),
    })
    return rules.gate_items(rows, "claim_id", audit.claim_gate_rules()).select("claim_id.*", "item_id", "kind")


@query(f"WITH {_GATED} SELECT conv_id, turn, split_part(item, ' ', 1) AS item_id, split_part(item, ' ', 2) AS kind FROM items")
def gated_statements(spark, sf_dir):
    """What the gate holds against each turn as a statement; turns that are no complete sentence are still being edited: A4 P12 R11 X6."""
    return _gate_items(spark, sf_dir)


@query(f"""WITH {_GATED}, i AS (SELECT conv_id, split_part(item, ' ', 1) AS item_id, split_part(item, ' ', 2) AS kind FROM items), seen AS (SELECT *, conv_id % 3 = 0 AND item_id IN ('NEEDS_REVIEW', 'ATTESTED') AS known FROM i)
 SELECT conv_id, CASE WHEN bool_or(kind = 'fail') THEN 'FAIL' ELSE 'REVIEW_REQUIRED' END AS flag, count(*) FILTER (kind = 'fail') AS n_fail, count(*) FILTER (kind = 'review' AND NOT coalesce(known, false)) AS n_open, n_fail + n_open = 0 AS export_allowed FROM seen GROUP BY conv_id""")
def gated_conversations(spark, sf_dir):
    """The gate of each conversation as a run; every third has acknowledged what is to be reviewed or attested: A4 A5 A14 X10."""
    runs = table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select("conv_id").distinct()
    known = runs.select("conv_id", F.explode(F.array(F.lit("NEEDS_REVIEW"), F.lit("ATTESTED"))).alias("item_id"))
    return rules.gate(_gate_items(spark, sf_dir), known, "conv_id")


_TITLE = "regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '[0-9]', '', 'g')"


@query(f"""WITH w AS (SELECT page_id, {_TITLE} AS title, url FROM pages), c AS (SELECT *, [x FOR x IN regexp_split_to_array(title, ' +') IF x <> ''] AS words FROM w),
 f AS (SELECT *, CASE page_id % 6 WHEN 1 THEN 'never said ' ELSE '' END || array_to_string(words[1:CASE page_id % 6 WHEN 2 THEN 3 ELSE 5 END], ' ') AS quote, page_id % 6 = 3 AS unknown, page_id % 6 = 4 AS bare, page_id % 4 = 1 AS counted FROM c),
 m AS (SELECT *, {_norm('quote')} AS s, {_norm('title')} AS body FROM f), d AS (SELECT *, len(regexp_split_to_array(regexp_replace(quote, '^ +| +$', '', 'g'), '\\s+')) < 4 AS short, NOT unknown AND s <> '' AND contains(body, s) AND regexp_matches(body, {_EDGES}) AS stands FROM m q),
 x AS (SELECT *, [y FOR y IN [CASE WHEN unknown THEN 'unknown source' END, CASE WHEN bare THEN 'no source cited' END, CASE WHEN bare THEN 'no quote given' END, CASE WHEN NOT bare AND short THEN 'quote too short' END,
   CASE WHEN NOT bare AND NOT short AND NOT stands THEN 'quote not in its sources' END, CASE WHEN counted THEN 'number not in the quotes' END] IF y IS NOT NULL] AS problems FROM d)
 SELECT page_id, CASE WHEN len(problems) = 0 THEN 'WEB_SOURCED' WHEN page_id % 5 = 0 THEN 'ASSUMPTION' ELSE 'MODEL_KNOWLEDGE' END AS status, array_to_string(problems, ', ') AS problems FROM x""")
def checked_facts(spark, sf_dir):
    """Facts said to be from pages, against the titles that they quote, some with other words, sources or numbers: R8 X26."""
    title = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)", 1), "[0-9]", "")
    pages = spread(table(spark, sf_dir, "pages")).select("page_id", F.coalesce(title, F.lit("")).alias("title"))
    words = F.filter(F.split("title", " +"), lambda w: w != "")
    quote = F.concat(F.when(F.expr("page_id % 6 = 1"), "never said ").otherwise(""), F.array_join(F.slice(words, 1, F.when(F.expr("page_id % 6 = 2"), 3).otherwise(5)), " "))
    bare = F.expr("page_id % 6 = 4")
    facts = pages.select(
        F.col("page_id").alias("run_id"), F.lit("f").alias("fact_id"), F.lit("industry").alias("field"), F.concat(F.lit("it makes steel"), F.when(F.expr("page_id % 4 = 1"), " in 12 countries").otherwise("")).alias("value"), F.lit("WEB_SOURCED").alias("status"), F.lit(None).cast("string").alias("company"), F.expr("page_id % 5 <> 0").alias("recognised"),
        F.when(bare, F.array().cast("array<string>")).otherwise(F.array(F.when(F.expr("page_id % 6 = 3"), "W9").otherwise("W1"))).alias("source_ids"), F.when(bare, F.array().cast("array<string>")).otherwise(F.array(quote)).alias("quotes"),
    )
    out = audit.resolved_facts(facts, pages.select(F.col("page_id").alias("run_id"), F.lit("W1").alias("source_id"), F.col("title").alias("content")))
    return out.select(F.col("run_id").alias("page_id"), "status", F.array_join("problems", ", ").alias("problems"))


#: Firms that are asked about in each language; the words are of the driver's texts and hosts, whose common parent is left out.
FIRMS = {"en": "Than Tionsh Ltd", "fr": "Pour Tionsh", "de": "Nicht Tionsh plc", "es": "Para Ththan"}
_TOKENS_OF = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v.lower().split() if w not in t.NAME_FILLERS)}]" for k, v in FIRMS.items())


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang, replace(lower(url), '.example.', '.') AS url, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '\s+', ' ', 'g')) AS head, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS raw FROM pages),
 line AS (SELECT page_id, head, trim(regexp_replace(u.s, '\s+', ' ', 'g')) AS s, u.ord FROM p, unnest(regexp_split_to_array(raw, '\r\n|[\n\r]')) WITH ORDINALITY AS u(s, ord)),
 kept AS (SELECT page_id, s, min(ord) AS ord FROM line WHERE length(s) >= 30 AND NOT regexp_matches(s, '{_BOILER}') AND NOT contains(head, s) GROUP BY page_id, s),
 body AS (SELECT page_id, string_agg(s, chr(10) ORDER BY ord) AS b FROM kept GROUP BY page_id),
 x AS (SELECT page_id, lang, CASE lang {_TOKENS_OF} END AS words, head, left(CASE WHEN head = '' THEN coalesce(b, '') WHEN b IS NULL THEN head ELSE head || chr(10) || b END, 4000) AS text, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^(www[0-9]*|en|m)\.', '') AS site, page_id * 7919 % 1000 AS score FROM p LEFT JOIN body USING (page_id)),
 o AS (SELECT *, string_split(site, '.') AS parts, array_to_string(words, '') AS whole, parts[greatest(len(parts) - 1, 1)] AS label, list_contains(words, label) OR label = whole OR starts_with(label, whole) AS official FROM x WHERE words IS NOT NULL AND text <> ''),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY official DESC, score DESC, page_id) AS rank FROM o WHERE len([w FOR w IN words IF contains(lower(head || ' ' || text), w)]) > 0)
 SELECT lang, CAST(rank AS INTEGER) AS rank, page_id, official, length(text) AS n_chars FROM r WHERE rank <= 6""")
def ranked_pages(spark, sf_dir):
    """Of the pages in a language that name the firm asked about, the six best: the firm's own ones first, then by score: T2 P15 P16 F11."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    lang = F.regexp_extract("html", 'lang="([a-z]*)"', 1)
    firm = F.coalesce(*[F.when(lang == k, v) for k, v in FIRMS.items()])
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    rows = pages.select("page_id", lang.alias("lang"), t.name_tokens(firm).alias("tokens"), F.replace(F.lower("url"), F.lit(".example."), F.lit(".")).alias("url"), t.squeezed(title).alias("title"), t.page_text(title, F.regexp_replace("html", "<[^>]*>", "\n")).alias("text"), F.expr("page_id * 7919 % 1000").alias("score")).where(firm.isNotNull())
    named = rows.where((F.col("text") != "") & F.exists("tokens", lambda w: F.contains(F.lower(F.concat_ws(" ", "title", "text")), w)))
    found = named.select("lang", "page_id", "score", t.is_official("url", F.col("tokens")).alias("official"), F.length("text").alias("n_chars"))
    return ordered.quota(found, ["lang"], [F.desc("official"), F.desc("score"), "page_id"], 6, "rank").select("lang", "rank", "page_id", "official", "n_chars")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents WHERE doc_id IS NOT NULL),
 k AS (SELECT *, place // 6 AS section, place % 6 = 0 AS heading, place % 6 = 5 OR len(regexp_extract_all(line, '\\S+')) >= {evidence.LEAST_WORDS} AS own FROM l),
 i AS (SELECT *, own OR (heading AND bool_or(own AND NOT heading) OVER (PARTITION BY doc_id, section)) AS citable FROM k),
 a AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
 qw AS (SELECT conv_id, turn, unnest({_TOKENS.format('text')}) AS w FROM a), iw AS (SELECT doc_id, place, unnest({_TOKENS.format("concat_ws(' ', section, line)")}) AS w FROM i WHERE citable),
 s AS (SELECT conv_id, turn, doc_id, place, count(*) AS score FROM qw JOIN iw ON conv_id = doc_id AND qw.w = iw.w GROUP BY ALL),
 top AS (SELECT conv_id, turn, place FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, place) <= 4)
 SELECT conv_id, turn, place FROM top UNION SELECT conv_id, turn, place + 4 FROM top WHERE place % 6 = 1 AND EXISTS (FROM i WHERE doc_id = conv_id AND i.place = top.place + 4)""")
def retrieved_lines(spark, sf_dir):
    """For each turn the four lines of its document that share most words with it, and their footnotes; headings, labels and short lines
    by the citable rule: T1 T3 T4 P1 P2 J2."""
    docs = spread(table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    kind = F.when(F.expr("ord % 6 = 0"), "HEADING").when(F.expr("ord % 6 = 5"), "FOOTNOTE").otherwise("TEXT")
    at = lambda n: F.struct(F.col("doc_id"), (F.col("ord") + n).alias("ord"))
    none = F.lit(None).cast("string")
    items = lines.select(F.col("doc_id").alias("document_id"), at(0).alias("evidence_id"), "ord", kind.alias("item_type"), F.expr("cast(ord div 6 as string)").alias("section"), none.alias("row_label"), none.alias("column_label"), "text", F.when(F.expr("ord % 6 = 1"), F.array(at(4))).otherwise(F.array().cast("array<struct<doc_id:bigint,ord:int>>")).alias("linked_footnote_ids"))
    asked = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    queries = asked.select(F.struct("conv_id", "turn").alias("query_id"), F.col("conv_id").alias("policy_id"), "text")
    found = selection.retrieved(queries, evidence.with_citable(items), 4)
    return found.select("query_id.*", F.col("ord").alias("place"))


@query(f"""WITH {_CLAIMS.split(',' + chr(10) + ' cl AS')[0]}, v AS (SELECT conv_id, turn, c, u, {_norm('said')} AS s, u % 2 = 0 AS numbered, 100 + c * 10 + u % 4 AS claimed, 100 + c * 10 + u % 3 AS given, u % 5 = 4 AS unknown FROM t),
 w AS (SELECT *, {_NAMED} FROM v) SELECT conv_id, turn, CASE WHEN unknown OR a OR b OR (numbered AND abs(claimed - given) > 0.005 * greatest(claimed, given)) THEN 'NEEDS_REVIEW' ELSE 'NON_FACTUAL' END AS status FROM w WHERE conv_id IS NOT NULL AND turn IS NOT NULL""")
def linked_statements(spark, sf_dir):
    """Turns as lines that say why something matters: their facts must exist, their amounts be those facts', and no product be named: R5 F4."""
    turns = _claims(spark, sf_dir).where("conv_id is not null and turn is not null")
    amount = lambda more: F.concat(F.lit("INR "), F.format_string("%d", F.col("conv_id") * 10 + 100 + more), F.lit(" in all. "))
    facts = turns.select("conv_id").distinct().select(F.col("conv_id").alias("run_id"), F.explode(F.array(*[F.struct(F.lit(f"f{i}").alias("fact_id"), amount(i).alias("value")) for i in range(3)])).alias("f")).select("run_id", "f.*")
    basis = F.array_compact(F.array(F.concat(F.lit("f"), F.expr("cast(turn % 3 as string)")), F.when(F.expr("turn % 5 = 4"), "f9")))
    claims = turns.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("claim_id"), F.concat(F.when(F.expr("turn % 2 = 0"), amount(F.expr("turn % 4"))).otherwise(""), "said").alias("text"), basis.alias("basis_fact_ids"))
    return audit.link_verdicts(claims, facts, ALIASES).select(F.col("run_id").alias("conv_id"), F.col("claim_id").alias("turn"), "status")
