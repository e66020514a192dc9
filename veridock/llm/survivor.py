"""Golden records: one record for each cluster of client rows, each field surviving by a rule of its own.

The fields are unpivoted to long rows (cluster, field, part, priority, value, id), one generic aggregate takes the row of least
priority for every field at once, and the result is pivoted back. A priority is a struct of numbers, compared from left to
right, so a rule is nothing but the numbers it puts first. Balances depend on the chosen segment: their best row is taken for
each segment and over all, and the record, once it has its segment, picks from these two.

Whether a record is stale depends on its cluster's latest update. Rows and latest updates meet by cluster and a salt, so a
cluster of any size is joined in many tasks; everything else about a cluster is aggregated, on the side of the scan first. No row
goes to the driver, into a broadcast, or with all the rows of its cluster into one task.

Defined cases: a null master_id makes a row its own cluster, and rows without both ids share the cluster null; blank strings are
nulls; balances that are no number or infinite count as null; a source outside the list has the lowest trust; equal rows, and rows
that repeat an id, are counted each, and ties between them go to the least value; a field that no row of a cluster has is null and so
is its ``_from``; an empty table gives an empty result; timestamps with and without a zone are compared to the microsecond.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm.common import table, written

#: Sources by falling trust, and how far behind its cluster's latest update a record may be.
TRUST = ("partner", "store", "web", "crm")
STALE_MICROS = 30 * 24 * 3600 * 1_000_000
#: Tasks that one cluster's rows are joined in.
SALTS = 64

_KEY = ("_k", "_none")
_BLANK = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Field:
    """What survives as ``name``: rows where ``present`` holds compete; ``first`` goes before the order, which is by recency or
    by trust; ``part`` splits the field, so that each part has a survivor."""

    name: str
    present: Column
    first: Column
    trusted: bool
    text: Column | None = None
    number: Column | None = None
    place: Column | None = None
    part: Column | None = None

    def row(self) -> Column:
        zero = F.lit(0)
        lead = [self.first.cast("long").alias("first"), (F.col("stale") if self.trusted else zero).cast("int").alias("stale"), (F.col("trust") if self.trusted else zero).cast("int").alias("trust")]
        last = [F.col("micros").isNull().alias("undated"), (-F.coalesce("micros", F.lit(0))).alias("age"), F.col("trust").cast("int").alias("source"), F.col("client_id").isNull().alias("no_id"), F.coalesce("client_id", F.lit(0)).alias("id")]
        value = [F.lit(None).cast(t).alias(n) if c is None else c.cast(t).alias(n) for n, t, c in (("text", "string", self.text), ("number", "double", self.number), ("place", "long", self.place))]
        ranked = F.struct(*lead, *last, *value, F.col("client_id").alias("of"))
        part = F.lit(None).cast("string") if self.part is None else self.part
        return F.struct(F.lit(self.name).alias("field"), part.alias("part"), self.present.alias("present"), ranked.alias("best"))


def _text(name: str) -> Column:
    return F.when(F.col(name).cast("string").rlike(_BLANK), F.col(name).cast("string"))


def cleaned(clients: DataFrame, trust: Sequence[str] = TRUST) -> DataFrame:
    """The rows with blanks as nulls, their cluster, the source's rank and the update in microseconds."""
    cluster = F.coalesce(F.col("master_id"), F.col("client_id")).cast("long")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in trust]), F.col("source")), F.lit(0))
    balance = F.col("balance").cast("double")
    return clients.select(
        F.coalesce(cluster, F.lit(0)).alias("_k"),
        cluster.isNull().alias("_none"),
        F.col("client_id").cast("long").alias("client_id"),
        F.when(rank == 0, len(trust)).otherwise(rank - 1).cast("int").alias("trust"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(updated_at AS TIMESTAMP_NTZ))").alias("micros"),
        *[_text(c).alias(c) for c in ("name", "email", "city", "segment")],
        F.col("nation_id").cast("long").alias("nation_id"),
        F.when(F.isnan(balance) | F.abs(balance).eqNullSafe(float("inf")), None).otherwise(balance).alias("balance"),
    )


def aged(rows: DataFrame, stale_micros: int = STALE_MICROS, salts: int = SALTS) -> DataFrame:
    """Rows with ``stale``: undated, or further than ``stale_micros`` behind the latest of their cluster. A cluster has one row of
    the other side for each salt that its own rows have, so nothing is multiplied."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("client_id", "micros", "trust"), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*_KEY, "_salt").agg(F.max("micros").alias("latest"))
    latest = parts.groupBy(*_KEY).agg(F.max("latest").alias("latest"), F.collect_list("_salt").alias("_salts"))  # SALTS at most
    sides = latest.select(*_KEY, "latest", F.explode("_salts").alias("_salt"))
    joined = salted.join(sides.hint("merge"), [*_KEY, "_salt"])
    return joined.withColumn("stale", (F.col("micros").isNull() | (F.col("latest") - F.col("micros") > stale_micros)).cast("int"))


def fields() -> list[Field]:
    """The rules. ``record`` survives nothing: it counts."""
    has = lambda c: F.col(c).isNotNull()
    filled = has("city").cast("int") + has("nation_id").cast("int")
    zero = F.lit(0)
    return [
        Field("record", F.lit(True), zero, False),
        Field("segment", has("segment"), zero, False, text=F.col("segment")),
        Field("email", has("email"), zero, True, text=F.col("email")),
        Field("name", has("name"), -F.length("name"), True, text=F.col("name")),
        Field("address", F.lit(True), -filled, True, text=F.col("city"), place=F.col("nation_id")),
        Field("balance", has("balance"), zero, False, number=F.col("balance")),
        Field("balance_of_segment", has("balance") & has("segment"), zero, False, number=F.col("balance"), part=F.col("segment")),
    ]


def survivors(rows: DataFrame, rules: Sequence[Field]) -> DataFrame:
    """(cluster, field, part, best, n, n_stale): for every field, and part of it, the row of least priority among those that
    have it, in one aggregate for all."""
    long = rows.select(*_KEY, "stale", F.explode(F.array(*[f.row() for f in rules])).alias("r")).where("r.present")
    return long.groupBy(*_KEY, F.col("r.field").alias("field"), F.col("r.part").alias("part")).agg(F.min("r.best").alias("best"), F.count("*").alias("n"), F.sum("stale").alias("n_stale"))


def golden_records(clients: DataFrame, trust: Sequence[str] = TRUST, stale_micros: int = STALE_MICROS) -> DataFrame:
    """One record for each cluster, with the balance as a double."""
    best = written(survivors(aged(cleaned(clients, trust), stale_micros), fields()), "survivors")
    of = lambda f, what: F.max(F.when(F.col("field") == f, F.col(what)))  # noqa: E731  one row each
    wide = best.where("part is null").groupBy(*_KEY).agg(of("record", "n").alias("n_records"), of("record", "n_stale").alias("n_stale"), *[of(f, "best").alias(f) for f in ("segment", "email", "name", "address", "balance")])
    wide = wide.withColumn("_segment", F.col("segment.text"))
    own = best.where("field = 'balance_of_segment'").select(*_KEY, F.col("part").alias("_segment"), F.col("best").alias("_own"))
    out = wide.join(own.hint("merge"), [*_KEY, "_segment"], "left").withColumn("balance", F.coalesce("_own", "balance"))
    placed = F.col("address.text").isNotNull() | F.col("address.place").isNotNull()
    return out.select(
        F.when(~F.col("_none"), F.col("_k")).alias("cluster_id"),
        "n_records",
        "n_stale",
        F.col("name.text").alias("name"),
        F.col("email.text").alias("email"),
        F.col("segment.text").alias("segment"),
        F.col("address.text").alias("city"),
        F.col("address.place").cast("int").alias("nation_id"),
        F.col("balance.number").alias("balance"),
        *[F.col(f"{f}.of").alias(f"{f}_from") for f in ("name", "email", "segment", "balance")],
        F.when(placed, F.col("address.of")).alias("address_from"),
    )


def op13_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = golden_records(table(spark, sf_dir, "clients"))
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long").alias("balance_cents")
    return out.select("cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", cents, "name_from", "email_from", "segment_from", "balance_from", "address_from")


_ORDER = "updated_at DESC NULLS LAST, trust, client_id"
_TRUSTED = f"stale, trust, {_ORDER}"


def _first(field: str, columns: str, source: str, where: str, order: str) -> str:
    return f"{field} AS (SELECT k, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS place FROM {source} WHERE {where}) WHERE place = 1)"


_BLANKS = ", ".join(f"CASE WHEN regexp_matches({c}, '[^\\x20\\x09-\\x0D]') THEN {c} END AS {c}" for c in ("name", "email", "city", "segment"))
SQL = {
    "op13_golden_records": f"""WITH rows AS (SELECT coalesce(master_id, client_id) AS k, client_id, updated_at, nation_id, balance, {_BLANKS},
  CASE source WHEN 'partner' THEN 0 WHEN 'store' THEN 1 WHEN 'web' THEN 2 WHEN 'crm' THEN 3 ELSE 4 END AS trust FROM clients),
 aged AS (SELECT *, coalesce(CAST(epoch_us(max(updated_at) OVER (PARTITION BY k)) - epoch_us(updated_at) > {STALE_MICROS} AS INT), 1) AS stale FROM rows),
 counts AS (SELECT k, count(*) AS n_records, CAST(sum(stale) AS BIGINT) AS n_stale FROM aged GROUP BY k),
 {_first("seg", "segment, client_id AS segment_from", "aged", "segment IS NOT NULL", _ORDER)},
 {_first("mail", "email, client_id AS email_from", "aged", "email IS NOT NULL", _TRUSTED)},
 {_first("nam", "name, client_id AS name_from", "aged", "name IS NOT NULL", f"length(name) DESC, {_TRUSTED}")},
 {_first("addr", "city, nation_id, CASE WHEN city IS NOT NULL OR nation_id IS NOT NULL THEN client_id END AS address_from", "aged", "true", f"(city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT DESC, {_TRUSTED}")},
 money AS (SELECT aged.*, aged.segment IS NOT DISTINCT FROM seg.segment AS same FROM aged LEFT JOIN seg ON aged.k IS NOT DISTINCT FROM seg.k),
 {_first("bal", "CAST(floor(100 * balance + 0.5) AS BIGINT) AS balance_cents, client_id AS balance_from", "money", "balance IS NOT NULL", f"same DESC, {_ORDER}")}
 SELECT c.k AS cluster_id, n_records, n_stale, name, email, segment, city, nation_id, balance_cents, name_from, email_from, segment_from, balance_from, address_from FROM counts c
 LEFT JOIN seg ON c.k IS NOT DISTINCT FROM seg.k LEFT JOIN mail ON c.k IS NOT DISTINCT FROM mail.k LEFT JOIN nam ON c.k IS NOT DISTINCT FROM nam.k LEFT JOIN addr ON c.k IS NOT DISTINCT FROM addr.k LEFT JOIN bal ON c.k IS NOT DISTINCT FROM bal.k"""
}
QUERIES = {"op13_golden_records": op13_golden_records}
