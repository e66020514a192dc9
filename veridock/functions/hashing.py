"""Content hashes and canonical keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    """sha256 of a text's or file's bytes."""
    return F.sha2(c.cast("binary"), 256)


def short_hash(*columns: Column) -> Column:
    """16 hex digits over columns in a fixed order; nulls and separators cannot collide with text."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]).cast("binary"), 256), F.lit(16))


def list_hash(hashes: Column) -> Column:
    """One hash for a set of hashes, whatever their order."""
    return F.left(F.sha2(F.array_join(F.array_sort(hashes), "\n").cast("binary"), 256), F.lit(16))


def map_key(m: Column) -> Column:
    """A map as text with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
