"""Work that is done again only where something changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridock.plans.registry import query
from veridock.session import scratch, table
from veridock.sources.snapshots import GONE, Snapshot

_VALUES = ("valid_at", "source", "segment", "city", "balance")
#: Changes from then on are applied to a snapshot of those before.
CUT = "2024-04-20"


@query(f"""SELECT client_id, seq, change_id, {', '.join(_VALUES)} FROM (SELECT * FROM client_changes QUALIFY row_number() OVER
 (PARTITION BY client_id ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST) = 1) WHERE op IS DISTINCT FROM 'D'""")
def client_snapshot(spark, sf_dir):
    """Clients as the changes leave them: a snapshot of those before a day, to which later ones, and some that come late, are applied:
    U2 U3 U4 U5 E4 J14."""
    changes = table(spark, sf_dir, "client_changes").select("client_id", "seq", "change_id", F.coalesce(F.col("op") == "D", F.lit(False)).alias(GONE), *_VALUES)
    before = F.coalesce(F.col("valid_at") < F.lit(CUT).cast("timestamp_ntz"), F.lit(False))
    kept = Snapshot(scratch(spark), "client_id", ("seq", "change_id"), 64)
    kept.write(changes.where(before & F.expr("change_id % 50 <> 7")))
    kept.apply(changes.where(~before))
    kept.apply(changes.where("change_id % 50 = 7 or change_id is null"))
    return kept.read(spark).select("client_id", "seq", "change_id", *_VALUES)
