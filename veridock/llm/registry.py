"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in ("urlfilter", "secrets", "langid", "pii", "neardup", "packing", "topk", "ann", "suffixdup", "mixing", "licenses", "convrepair", "survivor"):
    _module = importlib.import_module(f"veridock.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
