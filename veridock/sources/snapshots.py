"""Snapshots kept up to date: rows by key in buckets, of which a change rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.session import stored

GONE, BUCKET, DIGEST = "_gone", "_bucket", "_digest"


@dataclass(frozen=True)
class Snapshot:
    """Where a snapshot lies and how its rows are told apart.

    ``key`` identifies a row (null is a key like others). ``order``: columns that say which of two rows of a key is newer, unique up
    to repeated rows; with none, a row replaces the stored one wherever its content differs. ``buckets``: how many there are;
    a bucket is rewritten by one task, so a table has as many as make a bucket small. ``by``: SQL for what a bucket is
    dealt by, the key's hash if empty; with ids whose changes come together, such as ``key div 1000``, 1 % of
    keys touch about 1 % of buckets, while keys from anywhere touch as many buckets as there are keys, at most."""

    path: str
    key: str
    order: tuple[str, ...] = ()
    buckets: int = 64
    by: str = ""

    def _bucket(self) -> Column:
        return F.pmod(F.expr(self.by).cast("long") if self.by else F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def prepared(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key with bucket and content hash; ``_gone`` (false if absent) marks a deletion. One aggregate,
        combined before the shuffle, so a key of very many changes is no hot group."""
        rows = rows if GONE in rows.columns else rows.withColumn(GONE, F.lit(False))
        rest = [c for c in rows.columns if c not in (self.key, *self.order, BUCKET, DIGEST)]
        newest = rows.groupBy(self.key).agg(F.max(F.struct(*self.order, *rest)).alias("_row")).select(self.key, "_row.*")
        return newest.withColumn(BUCKET, self._bucket()).withColumn(DIGEST, F.sha2(F.to_json(F.struct(*sorted([*self.order, *rest]))), 256))

    def write(self, rows: DataFrame) -> None:
        """A whole new snapshot; what is marked as gone is kept as a mark, so that an older change that comes late stays without effect."""
        self._save(self.prepared(rows))

    def _save(self, rows: DataFrame) -> None:
        rows.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def _all(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows that are there."""
        return self._all(spark).where(~F.col(GONE)).drop(GONE, BUCKET, DIGEST)

    def differing(self, changes: DataFrame) -> DataFrame:
        """The changes that would change the snapshot. Of what is stored, only keys, order and content hashes are read."""
        new = self.prepared(changes)
        seen = [F.col(c).alias(f"_old_{i}") for i, c in enumerate((self.key, BUCKET, DIGEST, *self.order))]
        old = self._all(changes.sparkSession).select(*seen)
        both = new.join(old, (F.col(BUCKET) == F.col("_old_1")) & F.col(self.key).eqNullSafe(F.col("_old_0")), "left")
        newer = F.struct(*self.order) > F.struct(*[f"_old_{i + 3}" for i in range(len(self.order))]) if self.order else F.col(DIGEST) != F.col("_old_2")
        return both.where(F.col("_old_1").isNull() | newer).select(new.columns)

    def apply(self, changes: DataFrame) -> list[int]:
        """Changes written into the buckets they touch; returns those, of which there are never more than ``buckets``. No bucket is
        written from itself: the new rows are stored first. Applying the same changes again, after a failure or by mistake,
        ends in the same snapshot."""
        spark = changes.sparkSession
        real = stored(self.differing(changes))
        touched = sorted(r[0] for r in real.select(BUCKET).distinct().collect())
        if touched:
            old = self._all(spark).where(F.col(BUCKET).isin(touched)).select(real.columns)
            names = real.select(F.col(self.key).alias("_k"), F.col(BUCKET).alias("_b"))
            kept = old.join(names, (F.col(BUCKET) == F.col("_b")) & F.col(self.key).eqNullSafe(F.col("_k")), "left_anti")
            self._save(stored(kept.unionByName(real)))
        return touched


def stale_work(current: DataFrame, snapshot: Snapshot, keys: Sequence[str] = ()) -> DataFrame:
    """Keys whose work is to be done again as their content differs from the snapshot's, or they are new."""
    return snapshot.differing(current).select(snapshot.key, *keys)
