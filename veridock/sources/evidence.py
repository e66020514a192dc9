"""Sources of the evidence model: JSON documents, overrides, JSONL logs, YAML and Markdown records, binary files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from veridock.functions import textnorm as t

EVIDENCE = (
    "evidence_id string, document_id string, ord int, page int, section string, item_type string, text string, table_id string,"
    " row_label string, column_label string, footnote_markers array<string>, linked_footnote_ids array<string>, benefit_tier string,"
    " variant string, si_condition string, extraction_method string, citable boolean"
)
LOG = "timestamp string, run_id string, event string, actor string, payload string"
PREFIX = 40


def read_documents(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Extracted documents, one JSON file each: sha256, extraction_version and items. Files that do not parse, or are of
    another version, count as absent."""
    schema = T._parse_datatype_string(f"sha256 string, extraction_version string, items array<struct<{EVIDENCE.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean').replace(' array<string>', ':array<string>')}>>, _corrupt string")
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(F.col("_corrupt").isNull() & (F.col("extraction_version") == version)).drop("_corrupt")


def items(documents: DataFrame) -> DataFrame:
    return documents.select("sha256", F.explode("items").alias("i")).select("sha256", "i.*")


def key(c: Column) -> Column:
    """How selectors compare text: lower case, single spaces, the rupee sign as a backtick."""
    return F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit("₹"), F.lit("`"))), r"(?U)\s+", " "))


def selected(evidence: DataFrame, selectors: DataFrame) -> DataFrame:
    """(selector, evidence_id) pairs: same document and page, same type and row label if given, and equal text or, unless
    exact, a prefix of 40 characters or more."""
    s = selectors.select(F.col("ord").alias("selector"), F.col("document_id").alias("_d"), F.col("page").alias("_p"), F.col("item_type").alias("_t"), key(F.col("row_label")).alias("_r"), key(F.col("text_prefix")).alias("_x"), "exact")
    e = evidence.select("evidence_id", "document_id", "page", "item_type", key(F.coalesce("row_label", F.lit(""))).alias("_rl"), key(F.col("text")).alias("_tx"))
    near = (F.col("document_id") == F.col("_d")) & (F.col("page") == F.col("_p"))
    kind = (F.col("_t").isNull() | (F.col("item_type") == F.col("_t"))) & (F.col("_r").isNull() | (F.col("_rl") == F.col("_r")))
    text = (F.col("_tx") == F.col("_x")) | (~F.col("exact") & (F.length("_x") >= PREFIX) & F.startswith("_tx", F.col("_x")))
    return s.join(e, near & kind & text).select("selector", "evidence_id")


def unresolved(evidence: DataFrame, selectors: DataFrame) -> DataFrame:
    """Selectors that do not match exactly one item, with how many they match."""
    n = selected(evidence, selectors).groupBy("selector").count()
    return selectors.select(F.col("ord").alias("selector")).join(n, "selector", "left").select("selector", F.coalesce("count", F.lit(0)).alias("n")).where("n <> 1")


def overlaid(evidence: DataFrame, selectors: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Evidence with the labels that overrides set. ``selectors`` has one column ``new_<field>`` per field and the array
    ``fields_set``, as null is a value; later overrides win. Text never changes."""
    if "text" in fields:
        raise ValueError("evidence text is never changed")
    hits = selected(evidence, selectors).join(selectors.withColumnRenamed("ord", "selector").select("selector", "fields_set", *[f"new_{f}" for f in fields]), "selector")
    last = [F.max_by(F.struct(F.col(f"new_{f}").alias("v")), F.when(F.array_contains("fields_set", f), F.col("selector"))).alias(f"_{f}") for f in fields]
    sets = [F.max(F.array_contains("fields_set", f)).alias(f"_has_{f}") for f in fields]
    best = hits.groupBy("evidence_id").agg(*last, *sets)
    out = evidence.join(best, "evidence_id", "left")
    new = {f: F.when(F.coalesce(f"_has_{f}", F.lit(False)), F.col(f"_{f}.v")).otherwise(F.col(f)) for f in fields}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in evidence.columns])


def resolved_keys(keys: DataFrame, files: DataFrame, bundled: DataFrame) -> DataFrame:
    """Document keys to cache files: a sha256 names its file, a bundled id the sha256 of its document, ``POL-UPL-`` and a
    prefix the first file that begins with it. Keys without a file have none."""
    sha = F.when(F.col("key").rlike("^[0-9a-f]{64}$"), F.col("key"))
    k = keys.join(bundled.select(F.col("document_id").alias("key"), F.col("sha256").alias("_b")), "key", "left").withColumn("_sha", F.coalesce(sha, "_b"))
    k = k.withColumn("_prefix", F.when(F.startswith("key", F.lit("POL-UPL-")), F.lower(F.substring("key", 9, 64))))
    f = files.select("sha256", "path")
    exact = k.where("_sha is not null").join(f, F.col("_sha") == F.col("sha256"), "left").select("key", "path")
    near = k.where("_sha is null").join(f, F.startswith("sha256", F.col("_prefix")), "left").groupBy("key").agg(F.min("path").alias("path"))
    return exact.unionByName(near)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An append-only JSONL log: blank lines are skipped, a missing file is an empty log."""
    try:
        lines = spark.read.text(path).where("trim(value) <> ''")
    except Exception as e:  # Spark has one class for all analysis errors
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)
    rows = lines.select(F.from_json("value", LOG).alias("r"), "value")
    return rows.select("r.timestamp", "r.run_id", "r.event", "r.actor", F.coalesce("r.payload", F.get_json_object("value", "$.payload")).alias("payload"))


def yaml_table(spark: SparkSession, text: str, section: str, schema: str) -> DataFrame:
    """A list of records in a YAML file as a table in file order; ids that repeat are an error."""
    import yaml

    rows = yaml.safe_load(text)[section]
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    ids = [r.get("id") for r in rows]
    if len(set(ids)) < len(ids):
        raise ValueError("ids repeat")
    return spark.createDataFrame([tuple(i if n == "ord" else r.get(n) for n in names) for i, r in enumerate(rows)], schema)


def markdown_records(texts: DataFrame, column: str = "value") -> DataFrame:
    """``## ID — title`` sections with a ``| Field | Value |`` table as (record_id, title, fields)."""
    sections = texts.select(F.explode(F.split(column, r"(?m)^(?=## )")).alias("s")).where(F.col("s").rlike(r"^## [A-Z]+-\d+"))
    row = F.regexp_extract_all("s", F.lit(r"(?m)^\|\s*([^|\n]+?)\s*\|\s*[^|\n]*?\s*\|\s*$"), F.lit(1))
    value = F.regexp_extract_all("s", F.lit(r"(?m)^\|\s*[^|\n]+?\s*\|\s*([^|\n]*?)\s*\|\s*$"), F.lit(1))
    pairs = F.filter(F.arrays_zip(row.alias("k"), value.alias("v")), lambda p: ~p["k"].rlike("^(?:Field|:?-+:?)$"))
    return sections.select(F.regexp_extract("s", r"^## ([A-Z]+-\d+)", 1).alias("record_id"), F.regexp_extract("s", r"^## [A-Z]+-\d+\s*[—–-]\s*([^\n]*)", 1).alias("title"), F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))).alias("fields"))


def files(spark: SparkSession, path: str, largest: int) -> DataFrame:
    """Files with their content hash; oversized ones are told apart before their content is read.
    Spark's reader passes over empty ones."""
    rows = spark.read.format("binaryFile").load(path)
    small = rows.where(F.col("length") <= largest).select("path", "length", F.sha2("content", 256).alias("sha256"), F.when(~F.startswith("content", F.lit(b"%PDF")), "NOT_PDF").alias("issue"))
    big = rows.where(F.col("length") > largest).select("path", "length", F.lit(None).cast("string").alias("sha256"), F.lit("TOO_LARGE").alias("issue"))
    return small.unionByName(big)


def profile(rows: DataFrame, column: str = "value") -> DataFrame:
    """Frozen profiles: an old one without exposures is wrapped; facts that an exposure names but are not there are listed."""
    fact, exposure = "array<struct<fact_id:string,field:string,value:string,status:string>>", "array<struct<exposure_id:string,basis_fact_ids:array<string>>>"
    p = rows.select(F.from_json(column, f"struct<profile:struct<facts:{fact}>,exposures:{exposure},facts:{fact}>").alias("p"))
    p = p.select(F.coalesce("p.profile.facts", "p.facts").alias("facts"), F.coalesce("p.exposures", F.from_json(F.lit("[]"), exposure)).alias("exposures"))
    return p.withColumn("missing", F.array_except(F.flatten(F.transform("exposures", lambda e: e["basis_fact_ids"])), F.transform("facts", lambda f: f["fact_id"])))


# Fixed values.
ALWAYS_CITABLE = ("FOOTNOTE", "BULLET", "TABLE_CELL")
LEAST_WORDS, LOW_TEXT_WORDS = 4, 20
NAME_LENGTHS = (2, 120)


def with_citable(rows: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Items with whether they may be cited: footnotes, bullets and cells may, other items with a label or enough words, headings
    with enough words or a citable item of their document in their section."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"))) >= least
    labelled = (F.coalesce("row_label", F.lit("")) != "") | (F.coalesce("column_label", F.lit("")) != "")
    heading = F.col("item_type") == "HEADING"
    own = F.when(F.col("item_type").isin(*ALWAYS_CITABLE), True).when(heading, words).otherwise(labelled | words)
    d = rows.withColumn("_own", own).withColumn("_content", ~heading & own)
    filled = F.max("_content").over(W.partitionBy("document_id", "section"))
    return d.withColumn("citable", F.when(heading, F.col("_own") | F.coalesce(filled, F.lit(False))).otherwise(F.col("_own"))).drop("_own", "_content")


def line(rows: DataFrame) -> Column:
    """An item as one line for a prompt: fields between pipes, none of them with a pipe or line break, texts whole."""
    cell = lambda c: F.coalesce(F.nullif(F.translate(t.rupees_shown(c.cast("string")), "|\n", "/ "), F.lit("")), F.lit("-"))
    names = ["evidence_id", "page", "section", "row_label", "column_label", "tier", "variant", "si_condition"]
    return F.concat_ws(" | ", *[cell(rows[c]) for c in names], cell(F.array_join(rows["linked"], ",")), cell(rows["text"]))


def low_text(pages: DataFrame, words: DataFrame, by: str, least: int = LOW_TEXT_WORDS) -> DataFrame:
    """Pages with fewer words in their text layer than that, also those with none."""
    n = words.groupBy(by, "page").agg(F.count("*").alias("words"))
    return pages.join(n, [by, "page"], "left").withColumn("words", F.coalesce("words", F.lit(0))).where(F.col("words") < least)


def checked_name(given: Column) -> Column:
    """struct<name, code>: a company's name without blanks around it, or the code of the first rule it breaks."""
    name = F.trim(F.coalesce(given, F.lit("")))
    code = F.when(name == "", "MISSING_COMPANY_NAME").when(F.length(name) < NAME_LENGTHS[0], "COMPANY_NAME_TOO_SHORT").when(F.length(name) > NAME_LENGTHS[1], "COMPANY_NAME_TOO_LONG")
    return F.struct(F.when(code.isNull(), name).alias("name"), code.alias("code"))


def checked_choice(ids: Column, known: Sequence[str]) -> Column:
    """The code of the first rule that a choice from the library breaks: known entries, one of them, not more."""
    chosen = F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (F.trim(x) != "")))
    return F.when(F.exists(chosen, lambda x: ~x.isin(*known)), "UNKNOWN_POLICY").when(F.size(chosen) == 0, "NO_BUNDLED_POLICY").when(F.size(chosen) > 1, "TOO_MANY_BUNDLED_POLICIES")
